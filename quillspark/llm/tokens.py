"""Token ids in Re-Pair compressed shards (op 5).

Documents are dealt by range of doc_id (or of another order column), so that shards follow one another in ascending order. A
shard block holds whole documents, BLOCK ids or one longer document. In each block frequent pairs of symbols are replaced by
nonterminals, round after round, until no pair is found LEAST times; no pair crosses the end of a document, so each document
is a run of symbols. The block keeps its terminals (the ids that it uses), the rules (left, right), the symbols, and for each
document its id, its number of ids and where its symbols end; expansion lengths of the nonterminals give the place of
any id without decoding what stands before it (`ids_at`).

File format: a Parquet table in the shared folder, one row for each block: part, block, ids (of documents), sizes, ends,
terminals (uint32: id of each of the first symbols), rules (uint32 pairs of symbols, the rest), lengths (uint32 for each rule),
symbols (uint16, or uint32 if `wide`: where a block has over 65,536 different ones). All little-endian.

Defined results: null text is empty and has the end id alone; null doc_id comes first; rows with equal doc_id
are ordered by text, and repeated rows are all written; an empty table gives no blocks; further columns (of any name) are ignored.
A worker keeps its tokenizer and at most REMEMBERED chunks (of a batch, all). The tokenizer takes a text with odd white space or marks of special
tokens as a whole, with some 70 bytes of memory a byte. The session's Arrow batch limits are set (shared.py).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import materialise, ship_package

BLOCK = 1 << 20
END = 0
#: The least count of a frequent pair: a rule takes 12 bytes, and saves one symbol of 2 or 4 a place.
LEAST = 16
#: Distinct chunks whose ids an encoder remembers, some 120 MB.
REMEMBERED = 600_000
#: Bytes of text encoded at once (more text has fewer new chunks a byte), and texts that the tokenizer takes at once.
ENCODED, ROWS = 3 << 20, 32

#: Spaces that may not be cut at, white space and controls other than space and newline, and marks of special tokens.
ODD = r"[ \n] [ \n]|[ \n] $|[\x00-\x09\x0B-\x1F\x7F\x{85}\x{A0}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FEFF}]|<\|"


#: A control that no plain text holds: what follows it had no space before it.
CUT = "\x01"


def _cut(column: pa.Array) -> pa.Array:
    """Also cuts between a Latin letter or digit and the marks behind it, and before a lone newline, where the pattern always has a boundary: fewer different chunks."""
    column = pc.replace_substring_regex(column, r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([.,!?;:]+)", "\\1 \x01\\2")
    return pc.replace_substring_regex(column, r"([^ \n])\n([^ \n\x01])", "\\1 \x01\n\\2")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A chunk of Latin letters alone, which the pattern takes as one piece with the space before it.
WORD = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+$"


def _letters(tokenizer) -> np.ndarray | None:
    """Code points by which a byte-level tokenizer names the bytes, with a space for the newline; None if it isn't a plain one."""
    spec = json.loads(tokenizer.to_str())
    plain = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
    how = spec["pre_tokenizer"] or {}
    if not plain or how.get("type") != "ByteLevel" or how.get("add_prefix_space") or not how.get("use_regex", True):
        return None
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = np.zeros(256, dtype="<u4")
    names[own] = own
    names[[b for b in range(256) if b not in set(own)]] = 256 + np.arange(256 - len(own))
    names[10] = 32
    return names


def _for_words(tokenizer):
    """The same model for words whose bytes are named already, between spaces: it needs no pattern."""
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer.to_str())
    return Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "post_processor": None, "added_tokens": []}))


class Encoder:
    """Ids of whole texts. The byte-level pattern has a boundary before each space, but for those inside or at the end
    of a longer run of white space. So other texts are cut before each space, and equal chunks need the
    tokenizer once. Texts that match ODD go to the tokenizer as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.letters = _letters(self.tokenizer)
        self.words = None if self.letters is None else _for_words(self.tokenizer)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[k for x, k in vocabulary.items() if x.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        """spaced_chunks: chunks learnt with a space before them, to their numbers; bare_chunks: others. Chunk k has the ids flat[ends[k]:ends[k + 1]], and met[k] if it was met again."""
        self.spaced_chunks: dict[str, int] = {}
        self.bare_chunks: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.ends = np.zeros(1, dtype=np.int64)
        self.met = np.zeros(0, dtype=bool)

    def _thin(self) -> None:
        """Forgets the chunks that were not met again since they were learnt or last thinned out; all, if that leaves over half of REMEMBERED."""
        kept = np.flatnonzero(self.met)
        if len(kept) > REMEMBERED // 2:
            return self._forget()
        self.flat, self.ends = tk.gather(self.flat, self.ends[kept], self.ends[kept + 1])
        number, met = (np.cumsum(self.met) - 1).tolist(), self.met.tolist()
        self.spaced_chunks, self.bare_chunks = ({x: number[k] for x, k in chunks.items() if met[k]} for chunks in (self.spaced_chunks, self.bare_chunks))
        self.met = np.zeros(len(kept), dtype=bool)

    def _direct(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        batch = (tokenizer or self.tokenizer).encode_batch_fast
        return [np.array(e.ids, dtype=np.uint32) for k in range(0, len(texts), ROWS) for e in batch(texts[k : k + ROWS], add_special_tokens=False)]

    def _named(self, words: list[str]) -> str:
        return self.letters[np.frombuffer((" " + "\n ".join(words)).encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")

    def _learn(self, spaced: list[str], bare: list[str]) -> None:
        """Ids of new chunks. Those with a space before them go in long rows, words apart: no boundary moves, and only a chunk's first id begins with a space."""
        plain = pc.match_substring_regex(pa.array(spaced, pa.large_string()), WORD).to_pylist() if self.words else [False] * len(spaced)
        words, others = ([x for x, k in zip(spaced, plain, strict=True) if k == own] for own in (True, False))
        spaced = words + others
        rows = self._direct([self._named(words[k : k + 500]) for k in range(0, len(words), 500)], self.words)
        rows += self._direct([" " + " ".join(others[k : k + 500]) for k in range(0, len(others), 500)])
        flat = np.concatenate([np.zeros(0, dtype=np.uint32), *rows])
        begin = np.flatnonzero(self.spaced[flat])
        if len(begin) != len(spaced):
            raise ValueError("chunks and ids don't match")
        alone = self._direct(bare)
        sizes = np.concatenate([np.diff(np.append(begin, len(flat))), np.array([len(x) for x in alone], dtype=np.int64)])
        made = len(self.ends) - 1
        self.spaced_chunks.update(zip(spaced, range(made, made + len(spaced)), strict=True))
        self.bare_chunks.update(zip(bare, range(made + len(spaced), made + len(sizes)), strict=True))
        self.flat = np.concatenate([self.flat, flat, *alone])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.met = np.append(self.met, np.zeros(len(sizes), dtype=bool))

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(column, ODD).to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(column)
        rest = np.flatnonzero(odd)
        if len(rest):
            for k, ids in zip(rest, self._direct(column.take(pa.array(rest)).to_pylist()), strict=True):
                out[k] = ids
        plain = np.flatnonzero(~odd)
        if len(plain):
            chunks = pc.split_pattern(_cut(column.take(pa.array(plain))), " ")
            offsets = chunks.offsets.to_numpy()
            offsets = offsets - offsets[0]
            coded = chunks.flatten().dictionary_encode()
            ids, at = self._chunks(coded.dictionary, coded.indices.to_numpy(), offsets)
            for j, k in enumerate(plain):
                out[k] = ids[at[j] : at[j + 1]]
        return out

    def _chunks(self, names: pa.Array, index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # A text's first chunk has no space before it; its id in the table is that of the bare chunk.
        first = np.zeros(len(index), dtype=bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        bare, index = np.unique(index[first]), index.copy()
        index[first] = np.searchsorted(bare, index[first]) + len(names)
        marked = pc.starts_with(names, CUT).to_numpy(zero_copy_only=False)
        texts = names.to_numpy(zero_copy_only=False)
        after, alone = texts[~marked].tolist(), [x[1:] for x in texts[marked].tolist()] + texts[bare].tolist()
        place, new = self._places(after, alone)
        if len(self.ends) + sum(map(len, new)) > REMEMBERED:
            self._thin()
            place, new = self._places(after, alone)
        self.met[np.concatenate([at[at >= 0] for at in place])] = True
        if new[0] or new[1]:
            self._learn(new[0], list(dict.fromkeys(new[1])))
            for at, own in zip(place, self._places(*new)[0], strict=True):
                at[at < 0] = own
        number = np.empty(len(names) + len(bare), dtype=np.int64)
        apart = np.append(marked, np.ones(len(bare), dtype=bool))
        number[~apart], number[apart] = place
        number = number[index]
        ids, at = tk.gather(self.flat, self.ends[number], self.ends[number + 1])
        return ids, at[offsets]

    def _places(self, *wanted: list[str]) -> tuple[list[np.ndarray], list[list[str]]]:
        """Numbers of chunks with a space before them and of others, -1 for those that aren't known; and the unknown ones."""
        places = [np.fromiter(map(known.get, own, repeat(-1)), np.int64, len(own)) for known, own in zip((self.spaced_chunks, self.bare_chunks), wanted, strict=True)]
        return places, [[own[k] for k in np.flatnonzero(at < 0)] for at, own in zip(places, wanted, strict=True)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker: the file is read once, and chunks learnt stay known."""
    return Encoder(path)


#: Most cells of a table over the left and right symbols of frequent pairs; more pairs are searched for.
CELLS = 1 << 24


def _frequent(symbols: np.ndarray, look: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places `look`, those of pairs that are found LEAST times or more there, the pair's rank at each, and the pairs (n, 2) by rank: 0 is the most frequent one."""
    wide = alphabet > 1 << 16
    shift = np.uint64(32) if wide else np.uint32(16)
    left, right = symbols.take(look), symbols.take(look + 1)
    pair = (left.astype(np.uint64) if wide else left) << shift | right
    order = np.sort(pair)
    edge = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(edge, len(order)))
    often = times >= LEAST
    chosen, times = order[edge[often]], times[often]
    if not len(chosen):
        return look[:0], look[:0], np.zeros((0, 2), dtype=np.uint32)
    by_rank = np.lexsort((chosen, -times))
    rank = np.empty(len(chosen), dtype=np.int64)
    rank[by_rank] = np.arange(len(chosen))
    pairs = np.stack([chosen >> shift, chosen & type(shift)((1 << int(shift)) - 1)], axis=1).astype(np.uint32)
    # Row and column 0 are those of symbols in no frequent pair.
    row, column = np.zeros(alphabet, dtype=np.int64), np.zeros(alphabet, dtype=np.int64)
    for number, part in ((row, pairs[:, 0]), (column, pairs[:, 1])):
        number[part] = 1
        number[:] = np.where(number, np.cumsum(number), 0)
    width = int(column.max()) + 1
    if (int(row.max()) + 1) * width <= CELLS:
        row *= width
        table = np.zeros(int(row.max()) + width, dtype=np.uint16 if len(chosen) < 1 << 16 else np.uint32)
        table[row[pairs[:, 0]] + column[pairs[:, 1]]] = rank + 1
        found = table.take(row.take(left) + column.take(right))
        some = np.flatnonzero(found != 0)
        return look.take(some), found.take(some).astype(np.int64) - 1, pairs[by_rank]
    some = np.flatnonzero((row[left] > 0) & (column[right] > 0))
    pair = pair[some]
    place = np.minimum(np.searchsorted(chosen, pair), len(chosen) - 1)
    hit = chosen[place] == pair
    return look[some[hit]], rank[place[hit]], pairs[by_rank]


def _unbeaten(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places that no more frequent pair overlaps; in a run of one symbol, every second place from the left, if none overlaps the run."""
    side = at[1:] == at[:-1] + 1
    beaten = np.zeros(len(at), dtype=bool)
    beaten[1:] = side & (rank[:-1] < rank[1:])
    beaten[:-1] |= side & (rank[1:] < rank[:-1])
    take = ~beaten
    same = np.flatnonzero(side & (rank[1:] == rank[:-1]))
    if len(same):
        apart = np.flatnonzero(same[1:] != same[:-1] + 1)
        first, end = same[np.append(0, apart + 1)], same[np.append(apart, len(same) - 1)] + 1
        size = end - first + 1
        start = np.repeat(first, size)
        own = np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size)
        take[start + own] = ~np.repeat(beaten[first] | beaten[end], size) & (own & 1 == 0)
    return take


def compress(ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair until no pair occurs LEAST times: symbols, whether each is the last of its document, rules (n, 2), terminals.

    Symbol k stands for the id terminals[k], or for rule k - len(terminals). In a round every frequent pair is replaced
    where no more frequent one overlaps it, from the left in runs of one symbol. The most frequent pair always is, so
    every round makes the text shorter; a pair that wins less than half of LEAST places waits for a later round.
    """
    terminals = np.flatnonzero(np.bincount(ids))
    number = np.zeros(int(terminals[-1]) + 1, dtype=np.uint32)
    number[terminals] = np.arange(len(terminals))
    symbols, last = number[ids], last.copy()
    rules: list[np.ndarray] = []
    made = len(terminals)
    # A pair can only become frequent with a symbol of the round before; frequent pairs that were beaten are looked at again.
    again = ~last
    again[-1:] = False
    while True:
        at, rank, pairs = _frequent(symbols, np.flatnonzero(again), made)
        if not len(at):
            break
        take = _unbeaten(at, rank)
        good = 2 * np.bincount(rank[take], minlength=len(pairs)) >= LEAST
        take &= good[rank]
        again[:] = False
        again[at[~take]] = True
        chosen = np.flatnonzero(take)
        at, rank = at.take(chosen), rank.take(chosen)
        symbols[at] = (made + np.cumsum(good) - 1)[rank]
        last[at] = last[at + 1]
        again[at] = True
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        kept = np.flatnonzero(keep)
        symbols, last, again = symbols.take(kept), last.take(kept), again.take(kept)
        again[:-1] |= symbols[1:] >= made
        again &= ~last
        rules.append(pairs[good])
        made += len(rules[-1])
    return symbols, last, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32), terminals.astype(np.uint32)


def _layers(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Runs of rules that don't refer to one another: a round of replacement each, or more. Rules only refer to earlier ones."""
    top = rules.max(axis=1).astype(np.int64) if len(rules) else np.zeros(0, dtype=np.int64)
    done = 0
    while done < len(rules):
        to = done + int(np.argmax(np.append(top[done:] >= base + done, True)))
        yield done, to
        done = to


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Number of ids that each nonterminal stands for."""
    size = np.ones(base + len(rules), dtype=np.int64)
    for done, to in _layers(rules, base):
        size[base + done : base + to] = size[rules[done:to, 0]] + size[rules[done:to, 1]]
    return size[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: np.ndarray) -> np.ndarray:
    """Ids of a run of symbols: the rules are expanded once, and each symbol takes its part of that table."""
    flat, sizes = _expanded(rules, len(terminals))
    ends = np.cumsum(sizes)
    return terminals[tk.gather(flat, ends[symbols] - sizes[symbols], ends[symbols])[0]]


def _expanded(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Terminals of all symbols, one after the other, and how many each has. A rule is filled in from its two parts, which stand before it."""
    sizes = np.concatenate([np.ones(base, dtype=np.int64), lengths(rules, base)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(int(begin[-1]), dtype=np.uint32)
    flat[:base] = np.arange(base)
    for done, to in _layers(rules, base):
        for k, at in ((0, begin[base + done : base + to]), (1, begin[base + done : base + to] + sizes[rules[done:to, 0]])):
            part = rules[done:to, k]
            own, off = tk.gather(flat, begin[part], begin[part] + sizes[part])
            flat[np.repeat(at - off[:-1], np.diff(off)) + np.arange(int(off[-1]))] = own
    return flat, sizes


def ids_at(block: dict, doc: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of the doc-th document of a block, decoding only the symbols that hold them, by the lengths in the file."""
    symbols, rules, terminals = _unpacked(block)
    base = len(terminals)
    size = np.concatenate([np.ones(base, dtype=np.int64), np.frombuffer(block["lengths"], dtype=np.uint32).astype(np.int64)])
    a, b = ([0] + list(block["ends"]))[doc : doc + 2]
    ends = np.cumsum(size[symbols[a:b]])
    i = int(np.searchsorted(ends, start, side="right"))
    at, out = (int(ends[i - 1]) if i else 0), []
    stack = symbols[a + i : a + int(np.searchsorted(ends, stop)) + 1][::-1].tolist()
    while stack and at < stop:
        x = stack.pop()
        if at + size[x] <= start:
            at += int(size[x])
        elif x < base:
            out.append(terminals[x])
            at += 1
        else:
            stack += rules[x - base][::-1].tolist()
    return np.array(out, dtype=np.uint32)


def _unpacked(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    symbols = np.frombuffer(block["symbols"], dtype="<u4" if block["wide"] else "<u2").astype(np.uint32)
    return symbols, np.frombuffer(block["rules"], dtype="<u4").reshape(-1, 2), np.frombuffer(block["terminals"], dtype="<u4")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to ENCODED bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= ENCODED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


FILE = "part int, block int, ids array<long>, sizes array<long>, ends array<long>, terminals binary, rules binary, lengths binary, symbols binary, wide boolean"


def write(docs: DataFrame, tokenizer: str | None = None, order: Column | None = None) -> DataFrame:
    """Encodes docs and writes the shards to the shared folder, in ascending order of doc_id or of `order`; returns the table read back."""
    ship_package(docs.sparkSession)
    path = tokenizer or tokenizer_file()
    place = F.col("doc_id").cast("long") if order is None else order
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("place"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(n, F.asc_nulls_first("place")).sortWithinPartitions(*map(F.asc_nulls_first, ("place", "doc_id", "text"))).drop("place")

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, encoder = TaskContext.get().partitionId(), 0, encoder_of(path)
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        total = 0

        def give() -> pa.RecordBatch:
            flat = np.concatenate(held)
            sizes = np.array([len(x) for x in held], dtype=np.int64)
            last = np.zeros(len(flat), dtype=bool)
            last[np.cumsum(sizes) - 1] = True
            symbols, ends, rules, terminals = compress(flat, last)
            wide = len(terminals) + len(rules) > 1 << 16
            row = {"part": part, "block": block, "ids": list(ids), "sizes": sizes.tolist(), "ends": (np.flatnonzero(ends) + 1).tolist(), "wide": wide}
            row |= {"terminals": terminals, "rules": rules, "lengths": lengths(rules, len(terminals)).astype(np.uint32), "symbols": symbols.astype(np.uint32 if wide else np.uint16)}
            kinds = [("part", pa.int32()), ("block", pa.int32()), *[(k, pa.list_(pa.int64())) for k in ("ids", "sizes", "ends")], *[(k, pa.binary()) for k in ("terminals", "rules", "lengths", "symbols")], ("wide", pa.bool_())]
            return pa.RecordBatch.from_pylist([{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in row.items()}], schema=pa.schema(kinds))

        for batch in tk.pieces(_joined(batches), limit=ENCODED):
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), encoder.encode(tk.texts(batch.column("text"))), strict=True):
                if held and total + len(tokens) + 1 > BLOCK:
                    yield give()
                    ids, held, total, block = [], [], 0, block + 1
                ids.append(doc)
                held.append(np.append(tokens, np.uint32(END)).astype(np.uint32))
                total += len(tokens) + 1
        if held:
            yield give()

    return materialise(ordered.mapInArrow(run, FILE), "tokens")


def read(shards: DataFrame) -> DataFrame:
    """part, block, at (place in the block), doc_id, start (in the block), ids (little-endian uint32), from the files."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1).to_pylist()[0]
                flat = expand(*_unpacked(block)).astype("<u4")
                stop = np.cumsum(block["sizes"])
                start = stop - block["sizes"]
                for i in range(0, len(stop), 2000):
                    own = range(i, min(i + 2000, len(stop)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block["part"]] * len(own), pa.int32()), pa.array([block["block"]] * len(own), pa.int32()), pa.array(own, pa.int64()), pa.array([block["ids"][j] for j in own], pa.int64()), pa.array(start[own.start : own.stop], pa.int64()), pa.array([flat[start[j] : stop[j]].tobytes() for j in own], pa.binary())],
                        names=["part", "block", "at", "doc_id", "start", "ids"],
                    )

    return shards.mapInArrow(run, "part int, block int, at long, doc_id long, start long, ids binary")


def block_starts(shards: DataFrame) -> DataFrame:
    """part, block, before: ids of all blocks before. Within parts by a window; over parts there is one row for each."""
    sizes = shards.select("part", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    order = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0)))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    return inside.join(parts, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("before"))


def digest(docs: DataFrame, tokenizer: str | None = None, order: Column | None = None) -> DataFrame:
    shards = write(docs, tokenizer, order)
    rows = read(shards).select("part", "block", "at", "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return rows.join(block_starts(shards), ["part", "block"]).select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
