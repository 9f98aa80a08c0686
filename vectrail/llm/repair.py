"""Token ids in Re-Pair grammar files.

Documents go by range of (doc_id, text key) to sorted partitions; each task encodes whole texts, appends id 0, and
writes blocks of about `BLOCK` ids. A block holds a straight-line grammar: the most frequent pairs of neighbouring
symbols become nonterminals, `PAIRS` a round (occurrences that overlap are taken from the left), no pair crosses the end
of a document, and rounds go on until no pair occurs twice or the 15,279 numbers that 16 bits leave for rules are used
up. It stores the rules, every rule's expansion length, the symbols, and the symbols and ids of each document. A
document, or any range of ids, is decoded from its own symbols: their frames are unpacked and the rules they name expanded.

Block layout, little-endian: magic "RPG2", uint32 x 4 (documents, rules, symbols, ids), uint32 lengths of the parts, then
the parts, each zstd-compressed: rules as pairs of uint16 with their expansion lengths uint32; symbols and ids by document
uint32; symbols uint16 in frames of `FRAME`. Symbols under `TERMINALS` are ids, others rules. Blocks are kept as binary
cells of a Parquet table in the shared folder, which gives atomic task commits on any store that Spark writes to.

Texts are cut into pre-tokens in arrays; the tokenizers library's model merges each distinct one once per worker while
its cache (bounded) holds it: byte-level BPE never merges across pre-tokens. Texts with a special token's string are
encoded whole by the library's tokenizer.

Defined cases: a null or empty text is id 0 alone; null doc_ids come first; repeated doc_ids follow in order of a hash
of their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.common import as_long, binary_parts, read_table, row_keys, shared_table_path, shuffle_parts, slices
from vectrail.llm.words import Column, Words, ranges

MAGIC = b"RPG2"
TERMINALS = 50_257
RULES = 65_536 - TERMINALS
BLOCK = 1 << 19
FRAME = 1 << 15
PAIRS = 3_900
CACHE = 400_000
END = 0
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_state: dict = {}


def _classes(chars: np.ndarray) -> np.ndarray:
    """The class of each character in the pre-token pattern."""
    if "classes" not in _state:
        _state["classes"] = np.zeros(sys.maxunicode + 1, np.uint8)
        _state["classes"][WHITE] = SPACE
    kinds = _state["classes"]
    out = kinds[chars]
    if not out.all():
        for c in np.unique(chars[out == 0]).tolist():
            kinds[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
        out = kinds[chars]
    return out


def pretoken_starts(chars: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens in code points."""
    if not len(chars):
        return np.zeros(0, np.int64)
    kind = _classes(chars)
    fresh = np.zeros(len(chars) + 1, bool)
    fresh[doc_starts] = True
    start = np.concatenate([[True], kind[1:] != kind[:-1]]) | fresh[:-1]
    # the last of some white space before a word stands alone, or with the word if it is a space
    before = np.flatnonzero(start[1:] & ~fresh[1:-1] & (kind[:-1] == SPACE))
    start[before] = True
    start[before[chars[before] == 32] + 1] = False
    # an apostrophe that begins a pre-token takes one of some endings with it
    at = np.flatnonzero((chars == 39) & start)
    if len(at):
        pad = np.concatenate([chars, np.zeros(3, chars.dtype)])
        edge = np.concatenate([fresh, np.ones(3, bool)])
        one, two = pad[at + 1], pad[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~edge[at + 1]
        long = ~short & ~edge[at + 1] & ~edge[at + 2] & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        start[at[short | long] + 1] = False
        rest = np.concatenate([at[short] + 2, at[long] + 3])
        start[rest[rest < len(chars)]] = True
    return np.flatnonzero(start)


def _byte_letters() -> np.ndarray:
    """The code point that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256."""
    prints = np.zeros(256, bool)
    for lo, hi in ((33, 126), (161, 172), (174, 255)):
        prints[lo : hi + 1] = True
    return np.where(prints, np.arange(256), 255 + np.cumsum(~prints)).astype("<u4")


class Encoder:
    """Ids of texts by a tokenizer file (byte-level BPE) of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.words, self.flat, self.ends = Words(), Column(np.uint16), Column(np.int64)  # ids of all known words in a row
        self.ends.add(np.zeros(1, np.int64))

    def _shrink(self) -> None:
        kept = self.words.shrink(CACHE // 2)
        first, n = self.ends.all[kept], self.ends.all[kept + 1] - self.ends.all[kept]
        self.flat.keep(ranges(first, n))
        self.ends.held, self.ends.size = np.concatenate([[0], np.cumsum(n)]), len(kept) + 1

    def _merged(self, chars: np.ndarray, sizes: np.ndarray) -> None:
        """Append the ids of some words, as the library's model merges them."""
        raw = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        spelled = self.letters[raw].tobytes().decode("utf-32-le")
        first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        ends = first[np.cumsum(sizes)].tolist()
        merge = self.tokenizer.model.tokenize
        parts = [[t.id for t in merge(spelled[a:b])] for a, b in zip([0, *ends], ends)]
        self.flat.add(np.fromiter(chain.from_iterable(parts), np.uint16))
        self.ends.add(self.ends.all[-1] + np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and their numbers."""
        if len(self.words) > CACHE:
            self._shrink()
        text = raw.tobytes().decode()
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = pretoken_starts(chars, at)
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(off) - 1, np.int64)
        numbers, new = self.words.numbers(chars, starts)
        if len(new):
            sizes = np.diff(np.append(starts, len(chars)))[new]
            self._merged(chars[ranges(starts[new], sizes)], sizes)
        first = self.ends.all[numbers]
        n = self.ends.all[numbers + 1] - first
        ids = self.flat.all[ranges(first, n)]
        total = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, at)]
        if not any(x in text for x in self.special):
            return ids, np.diff(total)
        parts = [ids[a:b] for a, b in zip(total[:-1].tolist(), total[1:].tolist())]
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):  # special strings in texts are the whole tokenizer's matter
            if any(x in text[a:b] for x in self.special):
                parts[k] = np.array(self.tokenizer.encode(text[a:b], add_special_tokens=False).ids, np.uint16)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


#: The key of no pair: the last number is a rule's only if the numbers are used up, and no pair of it with itself is replaced.
NONE = np.uint32(0xFFFFFFFF)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(14)


def compress(ids: np.ndarray, sizes: np.ndarray, most: int = PAIRS) -> bytes:
    """A block of documents: `ids` of all, `sizes` by document. Rounds of at most `most` pairs go on until no pair occurs
    twice or the numbers for rules are used up."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes) - 1] = True
    rules: list[np.ndarray] = []
    count = 0
    table, number, nowhere = np.full(1 << 18, NONE, np.uint32), np.zeros(1 << 18, np.int32), _slot(np.array([NONE]))
    while len(seq) > 1 and count < RULES:
        key = (seq[:-1] << np.uint32(16)) | seq[1:]
        key[last[:-1]] = NONE
        ordered = np.sort(key)
        edge = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
        edge = np.concatenate([[0], edge, [len(ordered)]])
        times = np.diff(edge)
        times[ordered[edge[:-1]] == NONE] = 0
        pick = np.flatnonzero(times > 1)
        room = min(most, RULES - count)
        if len(pick) > room:
            pick = pick[np.argpartition(-times[pick], room - 1)[:room]]
        chosen = ordered[edge[pick]]
        own = _slot(chosen)
        number[own] = np.arange(len(chosen))
        chosen = chosen[number[own] == np.arange(len(chosen))]  # of two pairs in one slot one waits for the next round
        own = _slot(chosen)
        table[nowhere] = 0  # whose own place is another
        table[own], number[own] = chosen, np.arange(len(chosen))
        at = np.flatnonzero(table[_slot(key)] == key)
        rule = number[_slot(key[at])]
        table[own] = NONE
        run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1])) if len(at) else at
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at, rule = at[place % 2 == 0], rule[place % 2 == 0]
        # a pair that overlaps (a a a) may be left with one place, and one with none: such a round ends the grammar
        if len(at) < 2:
            break
        seq[at] = (TERMINALS + count + rule).astype(np.uint32)
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(chosen)
        count += len(chosen)
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    pairs = np.stack([flat >> 16, flat & 0xFFFF], axis=1).astype("<u2")
    lens = np.ones(65_536, np.uint32)
    base = TERMINALS
    for part in rules:
        lens[base : base + len(part)] = lens[part >> 16] + lens[part & 0xFFFF]
        base += len(part)
    symbols = np.diff(np.concatenate([[0], np.flatnonzero(last) + 1]))
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(b"".join(x.tobytes() for x in (pairs, lens[TERMINALS : TERMINALS + count].astype("<u4")))), pack(b"".join(x.astype("<u4").tobytes() for x in (symbols, sizes)))]
    parts += [pack(seq[i : i + FRAME].astype("<u2").tobytes()) for i in range(0, len(seq), FRAME)]
    head = np.array([len(sizes), count, len(seq), len(ids), *map(len, parts)], "<u4")
    return b"".join([MAGIC, head.tobytes(), *parts])


class Block:
    """A block as read back. Only the parts that are asked for are unpacked."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a grammar block")
        docs, rules, self.length, self.ids = np.frombuffer(raw, "<u4", 4, 4).tolist()
        lens = np.frombuffer(raw, "<u4", 2 + -(-self.length // FRAME), 20)
        self._ends = 20 + lens.nbytes + np.concatenate([[0], np.cumsum(lens.astype(np.int64))])
        self._raw, self._unpack = raw, zstandard.ZstdDecompressor().decompress
        body = self._part(0)
        self.rules = np.frombuffer(body, "<u2", 2 * rules).reshape(-1, 2)
        self.lens = np.concatenate([np.ones(TERMINALS, np.int64), np.frombuffer(body, "<u4", rules, 4 * rules)])
        high = self.rules.max(axis=1, initial=0)
        if (high >= TERMINALS + np.arange(rules)).any():
            raise ValueError("a rule refers to itself or a later one")
        tables = np.frombuffer(self._part(1), "<u4")
        self.symbols, self.sizes = tables[:docs], tables[docs:]
        self._flat = None

    def _part(self, k: int) -> bytes:
        return self._unpack(self._raw[int(self._ends[k]) : int(self._ends[k + 1])])

    def seq(self, lo: int, hi: int) -> np.ndarray:
        """Symbols lo to hi, from the frames that hold them."""
        first = lo // FRAME
        frames = [np.frombuffer(self._part(2 + k), "<u2") for k in range(first, -(-hi // FRAME))]
        return np.concatenate(frames)[lo - first * FRAME : hi - first * FRAME] if frames else np.zeros(0, "<u2")

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids of some symbols, rule by rule as far as the symbols need them."""
        while len(rule := np.flatnonzero(seq >= TERMINALS)):
            n = np.ones(len(seq), np.int64)
            n[rule] = 2
            out = np.repeat(seq, n)
            at = (np.cumsum(n) - n)[rule]
            pair = self.rules[seq[rule].astype(np.int64) - TERMINALS]
            out[at], out[at + 1] = pair[:, 0], pair[:, 1]
            seq = out
        return seq

    def all(self) -> np.ndarray:
        """All ids: every rule is expanded once, then copied wherever it stands."""
        n = self.lens[TERMINALS:]
        flat = np.concatenate([np.arange(TERMINALS, dtype=np.uint16), self.expand(np.arange(TERMINALS, TERMINALS + len(n)).astype("<u2"))])
        first = np.concatenate([np.arange(TERMINALS), TERMINALS + np.cumsum(n) - n])
        seq = self.seq(0, self.length)
        return flat[ranges(first[seq], self.lens[seq])]

    def document(self, k: int) -> np.ndarray:
        """Ids of one document, from its own symbols."""
        lo = int(self.symbols[:k].sum())
        return self.expand(self.seq(lo, lo + int(self.symbols[k])))

    def range(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the block, from the documents that hold them and of these the symbols that do."""
        ends = np.cumsum(self.sizes.astype(np.int64))
        i, j = np.searchsorted(ends, [lo, hi - 1], side="right")
        first = int(self.symbols[:i].sum())
        seq = self.seq(first, first + int(self.symbols[i : j + 1].sum()))
        start = int(ends[i] - self.sizes[i])
        reach = start + np.cumsum(self.lens[seq])
        a, b = np.searchsorted(reach, [lo, hi - 1], side="right")
        return self.expand(seq[a : b + 1])[lo - (int(reach[a - 1]) if a else start) :][: hi - lo]


def _write(path: str):
    def run(batches):
        if _state.get("path") != path:
            _state["path"], _state["encoder"] = path, Encoder(path)
        encoder, part = _state["encoder"], TaskContext.get().partitionId()
        ids, sizes, docs, held, base, seq = [], [], [], 0, 0, 0

        def block():
            all_ids, all_sizes = np.concatenate(ids), np.concatenate(sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([base], pa.int64()), pa.array([len(all_ids)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([compress(all_ids, all_sizes)], pa.binary())],
                names=["part", "seq", "base", "n_ids", "doc_ids", "block"],
            )

        for batch in batches:
            raw, off = binary_parts(batch.column(1))
            names = batch.column(0).to_pylist()
            for i, j in slices(off, 1 << 21):
                got, n = encoder.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                ids.append(np.insert(got, np.cumsum(n), END))
                sizes.append(n + 1)
                docs += names[i:j]
                held += len(got) + j - i
                if held >= BLOCK:
                    yield block()
                    base, seq = base + held, seq + 1
                    ids, sizes, docs, held = [], [], [], 0
        if held:
            yield block()

    return run


def write_ids(documents: DataFrame, where: str, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the grammar blocks of all documents, in ascending order of doc_id, to the folder `where`."""
    k1, k2 = row_keys(documents, doc_id, text)
    rows = documents.select(as_long(documents, doc_id).alias("doc_id"), F.col(text).alias("text"), k2)
    rows = rows.repartitionByRange(shuffle_parts(documents.sparkSession), F.col("doc_id").asc_nulls_first(), "k2")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "k2")
    blocks = rows.mapInArrow(_write(tokenizer), "part int, seq long, base long, n_ids long, doc_ids array<long>, block binary")
    blocks.write.option("compression", "uncompressed").parquet(where)


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row["block"])
            ids = block.all().astype("<u4")
            edges = np.concatenate([[0], np.cumsum(block.sizes.astype(np.int64))])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array(row["base"] + edges[:-1]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "start", "n_tokens", "ids_crc32"],
            )


def read_ids(spark, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    blocks = spark.read.parquet(where)
    # one row for each partition that wrote: as many as write tasks, whatever the number of documents
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    docs = blocks.select("part", "base", "doc_ids", "block").mapInArrow(_read, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op4_repair_ids(spark, sf_dir: str) -> DataFrame:
    """One row per document with the place and checksum of its ids in the files."""
    import public_tokenizers

    where = shared_table_path(spark, "ids")
    write_ids(read_table(spark, sf_dir, "documents"), where, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, where)
