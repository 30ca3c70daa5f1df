"""[I16] Tables with headers of several tiers as tables of one column a name, and bodies of one width.

A table is a relation of cells. Where a header cell stands follows from the cells before it: a grid of occupied intervals is folded over
the header's cells (one small array for each table), and each column's path is read down the grid. Bodies need no fold: a row's
cells are widened by themselves, and what a row must know of its table (its width, where the merged rows at its end begin)
are map-side aggregates, so a body may have any number of rows and a row is never collected with others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a wide parent, a wide table, a short value, and a merged row at a table's end.
WIDE_PARENT, WIDE_TABLE, SHORT, LONG_NOTE, WIDE_NOTE, REPEATED, DENSE = 3, 7, 6, 20, 4, 6, 8
NUMBERED = r"^\p{Nd}+[.)]?$"

#: Cells are handed on in batches that hold about these many characters of pages, not page by page.
BATCH_CHARS = 2 << 20

CELL = "row_no int, cell_no int, header boolean, rowspan int, colspan int, text string"


class _Cells(HTMLParser):
    """Cells of all tables of a page; a table inside a cell is a table of its own. Rows before the first without a heading are the header, unless there is a thead."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "table":
            self.open.append({"rows": [], "head": False, "any_head": False, "cell": None})
            self.tables.append(self.open[-1])
        elif self.open:
            table = self.open[-1]
            if tag in ("thead", "tbody", "tfoot"):
                table["head"] = tag == "thead"
                table["any_head"] |= table["head"]
            elif tag == "tr":
                table["rows"].append((table["head"], []))
                table["cell"] = None
            elif tag in ("td", "th"):
                if not table["rows"]:
                    table["rows"].append((table["head"], []))
                table["cell"] = {"th": tag == "th", "rowspan": _span(own.get("rowspan")), "colspan": _span(own.get("colspan")), "words": []}
                table["rows"][-1][1].append(table["cell"])

    def handle_endtag(self, tag):
        if self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1]["cell"] = None

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None and data.strip():
            self.open[-1]["cell"]["words"].append(data.strip())


def _span(value: str | None) -> int:
    return max(1, int(value)) if value and value.strip().isdecimal() else 1


def _rows(table: dict) -> Iterator[dict]:
    heading = True
    for row_no, (in_head, cells) in enumerate(table["rows"]):
        heading = heading and any(c["th"] for c in cells)
        for cell_no, c in enumerate(cells):
            yield {"row_no": row_no, "cell_no": cell_no, "header": in_head if table["any_head"] else heading, "rowspan": c["rowspan"], "colspan": c["colspan"], "text": " ".join(c["words"])}


def html_cells(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key, table_no and CELL of all tables of pages; text is joined by spaces."""
    kind = dict(pages.dtypes)[key]
    schema = pa.schema([("table_no", pa.int32()), ("row_no", pa.int32()), ("cell_no", pa.int32()), ("header", pa.bool_()), ("rowspan", pa.int32()), ("colspan", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0

            def flushed() -> pa.RecordBatch:
                columns = [pa.array([r[x.name] for r in rows], x.type) for x in schema]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, *schema.names])

            for k, text in enumerate(batch.column(1).to_pylist()):
                parser = _Cells()
                parser.feed(text or "")
                parser.close()
                own = [{"table_no": n, **cell} for n, table in enumerate(parser.tables) for cell in _rows(table)]
                rows += own
                at += [k] * len(own)
                held += len(text or "")
                if held >= BATCH_CHARS:
                    yield flushed()
                    at, rows, held = [], [], 0
            if rows:
                yield flushed()

    return pages.select(key, column).mapInArrow(run, f"{key} {kind}, table_no int, {CELL}")


def widths(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width: the most columns that any row of a table spans; n_head and top_row: rows of its header, and the first one."""
    rows = cells.groupBy(*keys, "row_no").agg(F.sum("colspan").cast("int").alias("w"), F.max("header").alias("header"))
    head = F.when(F.col("header"), F.col("row_no"))
    return rows.groupBy(*keys).agg(F.max("w").alias("width"), F.coalesce(F.max(head) - F.min(head) + 1, F.lit(0)).alias("n_head"), F.coalesce(F.min(head), F.lit(0)).alias("top_row"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, wherever use names it: a column that a lambda names may be computed anew for each element."""
    return F.transform(F.array(value), use)[0]


def _placed(cells: Column, width: Column) -> Column:
    """Header cells (tier, cell_no, rowspan, colspan, text), in order, each with the interval of columns that it occupies: the first free one on, counted
    from the end of the cell before it. What finds no free column is left out, with the rest of its row."""
    box = "array<struct<tier:int,below:int,first:int,past:int,text:string>>"
    start = F.struct(F.lit(-1).alias("tier"), F.lit(0).alias("next"), F.array().cast(box).alias("boxes"))

    def put(grid: Column, cell: Column) -> Column:
        at = F.when(grid["tier"] == cell["tier"], grid["next"]).otherwise(F.lit(0))
        taken = lambda x: F.exists(grid["boxes"], lambda b: (b["below"] > cell["tier"]) & (b["first"] <= x) & (x < b["past"]))
        first = F.when(at < width, F.array_min(F.filter(F.sequence(at, F.greatest(at, width - 1)), lambda x: ~taken(x))))

        def with_free(free: Column) -> Column:
            box_ = F.struct(cell["tier"].alias("tier"), (cell["tier"] + cell["rowspan"]).alias("below"), free.alias("first"), F.least(free + cell["colspan"], width).alias("past"), cell["text"].alias("text"))
            return F.struct(cell["tier"].alias("tier"), F.when(free.isNull(), width).otherwise(free + cell["colspan"]).alias("next"), F.when(free.isNull(), grid["boxes"]).otherwise(F.concat(grid["boxes"], F.array(box_))).alias("boxes"))

        return _once(first, with_free)

    return F.aggregate(cells, start, put, lambda grid: grid["boxes"])


def header_paths(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, col, path (labels of the tiers above a column, equal ones that follow one another once), label, for each column of tables with a header of two tiers or more.

    The label joins up to three tiers; a parent over WIDE_PARENT columns or more that doesn't begin the table is named in the first column instead of in its own.
    """
    size = widths(cells, keys).filter("n_head > 1")
    heads = cells.filter("header").join(size, keys)
    tiers = heads.groupBy(*keys, "width", "n_head", "top_row").agg(F.array_sort(F.collect_list(F.struct("row_no", "cell_no", "rowspan", "colspan", "text"))).alias("own"))  # a header's cells alone
    ordered = F.transform("own", lambda c: F.struct((c["row_no"] - F.col("top_row")).alias("tier"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"), c["text"].alias("text")))
    placed = tiers.withColumn("cells", ordered).withColumn("boxes", _placed(F.col("cells"), F.col("width")))
    columns = F.sequence(F.lit(0), F.col("width") - 1)
    # The cell that was put last wins where spans overlap.
    seen = lambda boxes, r, c: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(boxes, lambda b: (b["tier"] <= r) & (r < b["below"]) & (b["first"] <= c) & (c < b["past"])), lambda b: b["text"])), -1)
    grid = _once(F.col("boxes"), lambda boxes: F.transform(columns, lambda c: F.transform(F.sequence(F.lit(0), F.col("n_head") - 1), lambda r: seen(boxes, r, c))))
    empty = F.array().cast("array<string>")
    path = lambda labels: F.aggregate(labels, empty, lambda p, x: F.when((F.coalesce(x, F.lit("")) == "") | F.coalesce(F.element_at(F.concat(F.array(F.lit("")), p), -1) == x, F.lit(False)), p).otherwise(F.concat(p, F.array(x))))
    paths = placed.withColumn("grid", grid).withColumn("paths", F.transform("grid", path)).withColumn("top", F.transform("grid", lambda g: F.get(g, F.lit(0))))
    # Runs of one label in the first tier; the last of equal labels counts.
    first = lambda top, i: (i == 0) | ~F.get(top, i).eqNullSafe(F.get(top, i - 1))
    starts = _once(F.col("top"), lambda top: F.filter(columns, lambda i: first(top, i)))
    runs = F.transform(starts, lambda s, k: F.struct(s.alias("first"), F.coalesce(F.get("starts", k + 1), F.col("width")).alias("past"), F.col("top")[s].alias("name")))
    wide = F.filter("runs", lambda r: (r["name"] != "") & (r["past"] - r["first"] >= WIDE_PARENT))
    last = F.filter("wide", lambda r: ~F.exists("wide", lambda o: (o["name"] == r["name"]) & (o["first"] > r["first"])))
    order = F.array_sort(F.transform("last", lambda r: F.struct(F.array_min(F.transform(F.filter("wide", lambda o: o["name"] == r["name"]), lambda o: o["first"])).alias("at"), r["first"].alias("first"), r["name"].alias("name"))))
    named = paths.withColumn("starts", starts).withColumn("runs", runs).withColumn("wide", wide).withColumn("last", last).withColumn("parents", F.filter(order, lambda r: r["first"] > 0))
    short = lambda p, c: F.when((F.size(p) > 1) & F.exists("parents", lambda r: (r["name"] == F.get(p, F.lit(0))) & (c >= r["first"])), F.slice(p, F.lit(2), F.size(p))).otherwise(p)
    joined = lambda p: F.when(F.size(p) == 0, "").when(F.size(p) == 1, p[0]).when(F.size(p) == 2, F.concat(p[0], F.lit("<br>("), p[1], F.lit(")"))).otherwise(F.concat(p[0], F.lit(": "), p[1], F.lit("<br>("), p[2], F.lit(")")))
    told = lambda own: F.aggregate("parents", own, lambda t, r: F.when(F.contains(t, r["name"]), t).when(t == "", r["name"]).otherwise(F.concat(r["name"], F.lit(" &amp;<br>"), t)))
    each = named.select(*keys, F.posexplode("paths").alias("col", "path"), "parents")
    label = joined(short(F.col("path"), F.col("col")))
    return each.select(*keys, "col", "path", F.when(F.col("col") == 0, told(label)).otherwise(label).alias("label"))


def body_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_no, part, texts: the body's rows at their table's width; dense: whether the table is wide.

    A short value over several columns stands in the middle one, a longer one in the first. A row that lacks one cell lacks its label, unless it
    begins with a number; others lack their end. In wide tables the merged rows at the end (notes and single values) are part 2: a label and a value, or one cell.
    """
    body = cells.filter(~F.col("header")).groupBy(*keys, "row_no").agg(F.array_sort(F.collect_list(F.struct("cell_no", "colspan", "text"))).alias("own"))  # one row's cells
    rows = body.join(widths(cells, keys), keys).withColumn("n", F.size("own"))
    value, rest = F.get("own", F.lit(1)), F.slice(F.transform("own", lambda c: c["text"]), F.lit(2), F.size("own"))
    same = (F.col("n") >= REPEATED) & (F.size(F.array_distinct(rest)) == 1) & (F.get(rest, F.lit(0)) != "")
    rows = rows.withColumn("same", F.coalesce(same, F.lit(False)))
    # The last row of one or two cells, then the last row that isn't merged: two aggregates for each table.
    few = rows.groupBy(*keys).agg(F.max(F.when(F.col("n") <= 2, F.col("row_no"))).alias("last_few"), F.count("*").alias("n_rows"), F.min("row_no").alias("first_row"))
    rows = rows.join(few, keys)
    note = (F.col("n") == 2) & ((value["colspan"] >= WIDE_NOTE) | (F.length(value["text"]) > LONG_NOTE))
    again = F.col("same") & ((F.length(F.get(rest, F.lit(0))) > LONG_NOTE) | ((F.col("row_no") > F.col("first_row")) & (F.col("last_few") > F.col("row_no"))))
    rows = rows.withColumn("merged", F.coalesce((F.col("n") == 1) | note | again, F.lit(False)))
    ends = rows.groupBy(*keys).agg(F.max(F.when(~F.col("merged"), F.col("row_no"))).alias("last_full"))
    rows = rows.join(ends, keys)
    tail = (F.col("width") >= WIDE_TABLE) & (F.col("n_rows") >= 2) & F.col("last_full").isNotNull() & (F.col("row_no") > F.col("last_full"))
    rows = rows.withColumn("part", F.when(tail, 2).otherwise(1))
    blank = F.array(F.lit(""))
    short = lambda t: F.length(t) <= SHORT

    def widened(c: Column) -> Column:
        at = F.when(short(c["text"]), F.floor(c["colspan"] / 2).cast("int")).otherwise(F.lit(0))
        return F.concat(F.array_repeat(F.lit(""), at), F.array(c["text"]), F.array_repeat(F.lit(""), c["colspan"] - at - 1))

    wide = F.flatten(F.transform("own", widened))
    middle = F.when(short(F.get(rest, F.lit(0))), F.lit(1) + F.floor((F.col("n") - 1) / 2).cast("int")).otherwise(F.lit(1))
    once = F.concat(F.array(F.col("own")[0]["text"]), F.array_repeat(F.lit(""), middle - 1), F.array(F.get(rest, F.lit(0))), F.array_repeat(F.lit(""), F.col("n") - 1 - middle))
    lacks = F.col("width") - F.size(wide)
    lead = (lacks == 1) & ~F.get(wide, F.lit(0)).rlike(NUMBERED)
    fitted = F.when(lacks <= 0, wide).when(lead, F.concat(blank, wide)).otherwise(F.concat(wide, F.array_repeat(F.lit(""), F.greatest(lacks, F.lit(0)))))
    texts = F.when(F.col("part") == 2, F.slice(F.transform("own", lambda c: c["text"]), F.lit(1), F.lit(2))).when(F.col("same"), once).otherwise(fitted)
    return rows.select(*keys, "row_no", "part", texts.alias("texts"), (F.col("width") >= DENSE).alias("dense"))
