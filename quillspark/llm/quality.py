"""Line-first quality rules (op 6), in DataFrame functions only.

Every line is judged by itself: punctuation (a line of five words or more needs a sentence end, and at most
a fifth of its characters may be marks), navigation (menus cut by bars or arrows, lines of menu words) and
boilerplate (fixed phrases of page furniture), in English, French, German and Spanish. Failed lines go; a document that loses
more than half of its characters is rejected. Document-wide base rules come first: fewer than 50 words, or more than half of the
words in repeated three-word windows.

Defined results: null text counts as empty and fails; ties and repeated rows are judged one by one; an empty table gives an
empty one. `clean` keeps all columns, of any name; it sets text, and n_chars where docs has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import fresh

SPACE = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT = 50, 50
#: Longer lines are no menus.
MENU_LINE = 200

SENTENCE_END = r"[.!?…]([\x20\"'”»)\]]|$)"
MARKS = r"[!#*$%&|<>=_~^{}\[\]\\]"
BARS = r"(\|[^|]*){3}|([»›→][^»›→]*){3}"
#: Words of menus; a line of nothing but them is navigation.
MENU_WORDS = (
    "home|menu|login|log in|sign in|sign up|register|search|next|previous|back|share|print|contact|contact us|about|about us|sitemap|help|faq|top|more|read more|subscribe"
    "|accueil|connexion|se connecter|inscription|s'inscrire|recherche|rechercher|suivant|précédent|retour|partager|imprimer|contactez-nous|à propos|plan du site|aide|haut de page|en savoir plus|lire la suite|s'abonner"
    "|startseite|anmelden|einloggen|registrieren|suche|suchen|weiter|zurück|teilen|drucken|kontakt|über uns|impressum|hilfe|nach oben|mehr|mehr erfahren|weiterlesen|abonnieren"
    "|inicio|menú|iniciar sesión|registrarse|buscar|siguiente|anterior|volver|compartir|imprimir|contacto|contáctenos|acerca de|sobre nosotros|mapa del sitio|ayuda|arriba|más|leer más|suscribirse"
)
MENU = rf"^({MENU_WORDS})([ ,/·-]+({MENU_WORDS}))*[ .]*$"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "lorem ipsum", "enable javascript", "cookie policy", "uses cookies", "use of cookies", "terms of use", "terms of service", "privacy policy", "click here to", "page not found", "skip to content", "share this post", "share this page", "share this article", "powered by wordpress",
    "activer javascript", "politique de cookies", "utilise des cookies", "utilisation de cookies", "conditions d'utilisation", "mentions légales", "politique de confidentialité", "cliquez ici pour", "page introuvable", "aller au contenu", "partager cet article", "propulsé par wordpress",
    "javascript aktivieren", "cookie-richtlinie", "verwendet cookies", "verwendung von cookies", "nutzungsbedingungen", "datenschutzerklärung", "klicken sie hier", "seite nicht gefunden", "zum inhalt springen", "diesen artikel teilen", "diesen beitrag teilen", "präsentiert von wordpress",
    "activar javascript", "habilite javascript", "política de cookies", "utiliza cookies", "uso de cookies", "términos de uso", "condiciones de uso", "aviso legal", "política de privacidad", "haga clic aquí", "página no encontrada", "saltar al contenido", "ir al contenido", "compartir este artículo", "funciona con wordpress",
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Binds a value to a lambda variable, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _covered(positions: Column) -> Column:
    """Words covered by three-word windows at sorted positions."""
    return let(positions, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))


def repeat_words(all_words: Column) -> Column:
    """Words in three-word windows found twice or more."""

    def of(w: Column) -> Column:
        grams = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

        def positions(g: Column) -> Column:
            order = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            twice = let(order, lambda s: F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(positions(g))))

    return let(all_words, of)


def line_fails(line: Column) -> Column:
    low = F.translate(F.trim(line), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    few = F.size(words(line)) < 5  # a pattern for five words would try each place of a very long word
    punctuation = ~(line.rlike(SENTENCE_END) | few) | (F.regexp_count(line, F.lit(MARKS)) * 5 > F.length(line))
    bar = line.contains("|") | line.contains("»") | line.contains("›") | line.contains("→")

    def furniture(x: Column) -> Column:
        out = (F.length(x) < MENU_LINE) & x.rlike(MENU)
        for phrase in BOILERPLATE:
            out = out | x.contains(phrase)
        return out

    return punctuation | (bar & line.rlike(BARS)) | let(low, furniture)  # a variable of a lambda is computed once, an expression for each use


def judged(docs: DataFrame, name: str = "_q") -> DataFrame:
    """docs with one more struct column: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w, l = fresh(docs, "quill_words", "quill_lines")
    out = docs.withColumn(w, words(text)).withColumn(l, F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != ""))
    lines = F.col(l)
    out = out.withColumn(
        name,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(F.col(w)).cast("long").alias("n_repeat_words"),
            F.filter(lines, lambda x: ~line_fails(x)).alias("good"),
            F.length(F.array_join(lines, "")).alias("chars"),
        ),
    )
    q = F.col(name)
    base_failed = (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT)
    kept = ~base_failed & (F.length(F.array_join(q["good"], "")) * 2 >= q["chars"])
    return out.withColumn(name, q.withField("base_failed", base_failed).withField("kept", kept)).drop(w, l)


def digest(docs: DataFrame) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(docs.select("doc_id", "text")).select("doc_id", *[F.col("_q")[n].alias(n) for n in names])


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their failed lines; blank lines between good ones go, too, if any line fails.

    The row number is no part of the result: a projection that holds one isn't merged into the filter above it, so the rules are computed once for a
    row, not once for the filter and again for the text.
    """
    name, row = fresh(docs, "quill_quality", "quill_row")
    q = F.col(name)
    whole = F.length(F.array_join(q["good"], "")) == q["chars"]
    text = F.when(q["kept"], F.when(whole, F.col("text")).otherwise(F.array_join(q["good"], "\n")))
    out = judged(docs, name).withColumns({"text": text, row: F.monotonically_increasing_id()}).filter(F.col("text").isNotNull() & (F.col(row) >= 0))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(docs.columns)
