"""BPE encoding and decoding by forced boundaries (op 11).

A BPE token is a run of letters: the bytes of the alphabet and, where the vocabulary marks ends of words, each byte once more
as the last one of a word. Two neighbouring letters that stand side by side inside no token of the vocabulary are parted
in every encoding, as no merge can ever join them. A text's letters are cut at all such pairs, the fragments are encoded
independently, and their ids are concatenated. (A last letter begins no pair of any token, so ends of words are forced
cuts by the same table.) Each different fragment is encoded once, by a BPE model whose symbols are the letters.

Texts become letters as the tokenizer file says: its normaliser, pre-tokeniser and added tokens run with a vocabulary of the
bare letters. Words between ASCII white space are taken alone, and equal ones become ids once: a worker remembers REMEMBERED of
them. So the file must mark ends of words and drop white space; others are refused (ValueError). Words of plain characters
(printable ASCII but ' and <, and the letters from À to ÿ) become letters by a table of bytes, where probes show that the file's
rules are those of the table: lower case, and a boundary between letters, digits and the rest.

Defined results: a null or empty text has no ids and decodes to the empty text; null and repeated doc_ids, and repeated rows,
stay rows of their own; an empty table gives an empty one; columns other than doc_id and the text are ignored. Added tokens of the
file stand for themselves where their string is in a text. Truncation and padding of the file are unused.

Memory: some 25 bytes a byte of a text, and some 150 a byte for one word without white space. The session's Arrow batch limits are set (shared.py).
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import ship_package

#: Words, and fragments, whose ids a worker remembers.
REMEMBERED = 600_000
#: Bytes of text encoded at once.
ENCODED = 3 << 20
#: Letter k is this character for the BPE model: private use, so no tokenizer rule touches it.
FIRST_LETTER = 0xE000


#: Characters that the table of bytes is for: printable ASCII but ' and <, and the letters from À to ÿ, whose UTF-8 begins with LATIN.
PLAIN = "".join(map(chr, [k for k in range(0x21, 0x7F) if chr(k) not in "'<"] + [k for k in range(0xC0, 0x100) if k not in (0xD7, 0xF7)]))
LATIN = 0xC3
PLAIN_BYTE = np.zeros(256, dtype=bool)
PLAIN_BYTE[[0x20, *(ord(c) for c in PLAIN if c.isascii())]] = True
OTHER, SPACE, LETTER, DIGIT = range(4)
BYTE_KIND = np.full(256, OTHER, dtype=np.uint8)
BYTE_KIND[0x20], BYTE_KIND[0x30:0x3A], BYTE_KIND[0x61:0x7B], BYTE_KIND[0x80:] = SPACE, DIGIT, LETTER, LETTER


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered:
    """Ids of byte strings, made by `make` when first met: (values) -> ids of all values, n + 1 offsets."""

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.make = make
        self._forget()

    def _forget(self) -> None:
        self.values = pa.array([], pa.large_binary())
        self.flat, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def runs(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these different values begin and end in `flat`."""
        place = pc.fill_null(pc.index_in(values, value_set=self.values), -1).to_numpy().astype(np.int64)
        if len(self.values) + int((place < 0).sum()) > REMEMBERED and len(self.values):
            self._forget()
            place[:] = -1
        new = place < 0
        if new.any():
            added = values.filter(pa.array(new))
            flat, offsets = self.make(added)
            place[new] = len(self.values) + np.arange(len(added))
            self.values = pa.concat_arrays([self.values, added])
            self.flat, self.ends = np.concatenate([self.flat, flat]), np.concatenate([self.ends, self.ends[-1] + offsets[1:]])
        return self.ends[place], self.ends[place + 1]


class Codec:
    """Encodes and decodes with the tokenizer of a file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE tokenizer that marks ends of words")
        spec["truncation"] = spec["padding"] = spec["post_processor"] = None
        vocabulary = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = self._tokens_of(vocabulary, merges)
        names = [x for x in vocabulary if x not in made]
        number = {x: k for k, x in enumerate(names)}
        spell = lambda x: made[x] if x in made else (number[x],)
        written = lambda x: "".join(chr(FIRST_LETTER + k) for k in spell(x))
        self.bpe = Tokenizer(models.BPE({written(x): i for x, i in vocabulary.items()}, [(written(a), written(b)) for a, b in merges]))
        self.inside = np.zeros((len(names), len(names)), dtype=bool)
        for token in made:
            letters = spell(token)
            self.inside[letters[:-1], letters[1:]] = True
        spec["model"] = model | {"vocab": number, "merges": []}
        self.letters = Tokenizer.from_str(json.dumps(spec))
        self.letters.no_padding()
        self.letters.no_truncation()
        #: Letters from here on are added tokens; their ids by that number.
        self.added = {self.letters.token_to_id(x["content"]): x["id"] for x in spec["added_tokens"]}
        self.base = len(names)
        if not self._drops_white_space():
            raise ValueError("the tokenizer keeps white space")
        self.inner, self.end = np.zeros(256, dtype=np.uint32), np.zeros(256, dtype=np.uint32)
        self.plain = self._plain_tables()
        self.words, self.fragments = Remembered(self._ids_of_words), Remembered(self._ids_of_fragments)
        ids = vocabulary | {x["content"]: x["id"] for x in spec["added_tokens"]}
        table = [b""] * (max(ids.values()) + 1)
        for x, i in ids.items():
            table[i] = x.encode()
        self.decoder = Tokenizer.from_file(path) if spec.get("decoder") else None
        if self.decoder:
            self.decoder.no_padding()
        self.token_bytes = np.frombuffer(b"".join(x + b" " for x in table), dtype=np.uint8)
        self.token_ends = np.cumsum([0] + [len(x) + 1 for x in table])

    @staticmethod
    def _tokens_of(vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> dict[str, tuple[int, ...]]:
        """The letters of each token that a merge makes; letters are what no merge makes, numbered in the vocabulary's order."""
        results = {a + b for a, b in merges}
        number = {x: k for k, x in enumerate(x for x in vocabulary if x not in results)}
        out: dict[str, tuple[int, ...]] = {}
        for a, b in merges:
            if a + b not in out:
                out[a + b] = (out[a] if a in out else (number[a],)) + (out[b] if b in out else (number[b],))
        return out

    def _drops_white_space(self) -> bool:
        """Whether white space only parts words: then "a b" has the letters of "a" and "b", in all probes."""
        get = lambda x: self.letters.encode(x, add_special_tokens=False).ids
        return all(get(f"{a}{white}{white}{b}") == get(a) + get(b) for a in ("ab", "1", "?", "é'") for b in ("s", "2x", "!", "́e") for white in " \t\n\v\f\r")

    def _spelt(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of texts as the file's rules give them, and the n + 1 offsets."""
        lists = [e.ids for k in range(0, len(texts), 1000) for e in self.letters.encode_batch_fast(texts[k : k + 1000], add_special_tokens=False)]
        offsets = np.cumsum([0] + [len(x) for x in lists])
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(offsets[-1])), offsets

    def _plain_tables(self) -> bool:
        """Fills the tables of the letters that plain bytes become, inside and at the end of a word, and tries them on probes."""
        kind = lambda c: "z" if c.isalpha() else "" if c.isdigit() else c
        for c in PLAIN:
            raw = np.frombuffer(c.lower().encode(), dtype=np.uint8)
            first, last = self._spelt([c + kind(c)])[0], self._spelt([kind(c) + c])[0]
            if len(first) < len(raw) or len(last) < len(raw):
                return False
            self.inner[raw], self.end[raw[-1]] = first[: len(raw)], last[-1]
        rnd = np.random.default_rng(1)
        probes = ["".join(rnd.choice(list(PLAIN), 12)) + " " for _ in range(2000)] + [a + b + " " for a in PLAIN for b in PLAIN]
        flat, offsets = self._tabled(pa.array(probes, pa.large_string()).cast(pa.large_binary()))
        want, places = self._spelt(probes)
        return np.array_equal(flat, want) and np.array_equal(offsets, places)

    def _tabled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Letters of plain words, each with a space behind it, and the n + 1 offsets."""
        data, off = tk.buffer(words)
        data = tk.LOWER[data]
        capital = np.flatnonzero((data[:-1] == LATIN) & (data[1:] < 0x9F)) + 1
        data[capital] += 32
        kind = BYTE_KIND[data]
        last = np.ones(len(data), dtype=bool)
        last[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == DIGIT)
        letters = np.where(last, self.end[data], self.inner[data])
        full = kind != SPACE
        return letters[full], np.concatenate([[0], np.cumsum(full)])[off]

    def _letters_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Letters of words, and the n + 1 offsets."""
        if not self.plain:
            return self._spelt(words.cast(pa.large_string()).to_pylist())
        data, off = tk.buffer(words)
        latin = np.concatenate([[False], data[:-1] == LATIN])
        good = np.where(data < 0x80, PLAIN_BYTE[data] & ~latin, (data == LATIN) & ~latin | latin & (data < 0xC0) & (data != 0x97) & (data != 0xB7))
        wrong = np.concatenate([[0], np.cumsum(~good)])[off]
        plain = np.diff(wrong) == 0
        tabled, at = self._tabled(words.filter(pa.array(plain)))
        spelt, there = self._spelt(words.filter(pa.array(~plain)).cast(pa.large_string()).to_pylist())
        flat = np.concatenate([tabled, spelt])
        starts, ends = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        starts[plain], ends[plain] = at[:-1], at[1:]
        starts[~plain], ends[~plain] = there[:-1] + len(tabled), there[1:] + len(tabled)
        return tk.gather(flat, starts, ends)

    def _ids_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Letters of the texts, cut at the forced boundaries; ids of the fragments, concatenated."""
        flat, offsets = self._letters_of(words)
        if not len(flat):
            return flat, np.zeros(len(words) + 1, dtype=np.int64)
        plain = flat < self.base
        cut = np.ones(len(flat), dtype=bool)
        both = np.flatnonzero(plain[:-1] & plain[1:])
        cut[both + 1] = ~self.inside[flat[both], flat[both + 1]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        coded = tk.binary_view((flat.astype("<u2") + np.uint16(FIRST_LETTER)).view(np.uint8), 2 * np.append(starts, len(flat))).dictionary_encode()
        begin, end = self.fragments.runs(coded.dictionary)
        index = coded.indices.to_numpy()
        ids, at = tk.gather(self.fragments.flat, begin[index], end[index])
        return ids, at[np.searchsorted(starts, offsets)]

    def _ids_of_fragments(self, fragments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = [x.decode("utf-16-le") for x in fragments.to_pylist()]
        lists = [e.ids for k in range(0, len(texts), 1000) for e in self.bpe.encode_batch_fast(texts[k : k + 1000], add_special_tokens=False)]
        for k, x in enumerate(texts):
            if ord(x[0]) - FIRST_LETTER >= self.base:
                lists[k] = [self.added[ord(x[0]) - FIRST_LETTER]]
        offsets = np.cumsum([0] + [len(x) for x in lists])
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(offsets[-1])), offsets

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 offsets."""
        words = tk.Words(texts)
        data, starts, _ = words.joined()
        coded = tk.binary_view(data, np.append(starts, len(data))).dictionary_encode()  # each with its space
        begin, end = self.words.runs(coded.dictionary)
        index = coded.indices.to_numpy()
        ids, at = tk.gather(self.words.flat, begin[index], end[index])
        return ids, at[words.offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of runs of ids; without a decoder in the file, tokens are joined by spaces."""
        if self.decoder:
            rows = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return pa.array(self.decoder.decode_batch(rows, skip_special_tokens=False), pa.large_string())
        if len(ids) and int(ids.max()) >= len(self.token_ends) - 1:
            raise ValueError("an id that the vocabulary doesn't have")
        data, at = tk.gather(self.token_bytes, self.token_ends[ids], self.token_ends[ids.astype(np.int64) + 1])
        # The space behind each text's last token goes.
        ends, full = at[offsets], np.diff(offsets) > 0
        keep = np.ones(len(data), dtype=bool)
        keep[ends[1:][full] - 1] = False
        lost = np.concatenate([[0], np.cumsum(full)])
        return tk.binary_view(data[keep], ends - lost).cast(pa.large_string())


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """One codec for all tasks of a Python worker: words learnt stay known."""
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, ids: the little-endian uint32 ids of each text."""
    ship_package(docs.sparkSession)
    path = tokenizer or tokenizer_file()

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in tk.pieces(batches, limit=ENCODED):
            ids, offsets = codec.encode(tk.texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tk.binary_array(ids.astype("<u4").view(np.uint8), 4 * offsets)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids, and the text that they decode to, special tokens included."""
    ship_package(encoded.sparkSession)
    path = tokenizer or tokenizer_file()

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in tk.pieces(batches, "ids", 4 * ENCODED // 3):
            column = pc.fill_null(batch.column("ids").cast(pa.large_binary()), b"")
            data, offsets = tk.buffer(column)
            decoded = codec.decode(np.frombuffer(data.tobytes(), dtype="<u4"), offsets // 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), decoded.cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    both = decode(encode(docs, tokenizer), tokenizer)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
