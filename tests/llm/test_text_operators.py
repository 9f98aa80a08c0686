"""Operators over texts against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vectrail.llm import components, decontaminate, exchange, pieces, repair, simhash, substring, suffix, toxicity
from vectrail.llm.common import binary_parts, shared_table_path, spread_join


def test_decontamination_equals_brute_force(spark, documents, texts, nothing):
    passage = texts[1][1].split(" ")
    items = [(1, " ".join(passage[35:60]).upper()), (2, "one two"), (3, None), (4, "!!"), (None, "café it"), (1, " ".join(passage[35:60])), (5, "never there at all " * 5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))

    def brute(text):
        words, hit, found = split(text), set(), set()
        for item, own in items:
            own = split(own)
            n = min(13, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                for i in range(len(words) - n + 1):
                    if words[i : i + n] == own[k : k + n]:
                        hit |= set(range(i, i + n))
                        found.add("null" if item is None else str(item))
        return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)

    want = sorted((i is None, i or 0, *brute(t)) for i, t in texts)
    for block in (2_000_000, 3):
        report, name = decontaminate.decontamination_report(documents, bench, block_words=block)
        got = report.select("doc_id", *(F.col(name)[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))).collect()
        assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == want
    assert any(w[-1] for w in want)
    kept = decontaminate.decontaminate(documents, bench)
    assert kept.columns == documents.columns and kept.count() == sum(not w[-1] for w in want)
    cut = decontaminate.decontaminate(documents, bench, remove="spans")
    assert cut.count() == documents.count() and " ".join(passage[35:60]) not in {r["text"] for r in cut.collect()}
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert decontaminate.decontaminate(documents, bench.limit(0)).count() == documents.count()


def test_substrings_equal_brute_force(spark, documents, texts, nothing):
    order = sorted({(i is not None, i or 0, t or ""): None for i, t in texts}, key=lambda r: r[:2])
    same = [r for r in order if r[1] == 16]
    hashes = {r["text"]: r["k2"] for r in documents.select("text", F.xxhash64("doc_id", "text").alias("k2")).collect()}
    order = sorted(order, key=lambda r: (r[0], r[1], hashes.get(r[2], hashes.get(None))))
    assert len(same) == 2
    seen, want = set(), {}
    for has, i, t in order:
        words = t.encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        want[(i if has else None, t)] = b" ".join(w for w, g in zip(words, gone) if not g).decode()
    kept = substring.remove_repeated_windows(documents)
    assert kept.columns == documents.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == sorted((i is None, i or 0, want[(i, t or "")]) for i, t in texts)
    assert sum(map(len, want.values())) < sum(len(" ".join((t or "").split())) for _, t in texts)
    assert substring.remove_repeated_windows(nothing).count() == 0


def brute_spans(texts, length):
    count, spans = {}, []
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), np.uint8).astype(int), [0]])))
        spans.append(list(zip(edges[::2].tolist(), edges[1::2].tolist())))
    return spans


def test_suffix_repeats_equal_brute_force(spark, documents, texts, nothing):
    raw = [(t or "").encode() for _, t in texts]
    want = sorted(suffix.cut(t, suffix.whole_characters(t, s)).decode() for t, s in zip(raw, brute_spans(raw, 400)))
    kept = suffix.remove_repeats(documents)
    assert kept.columns == documents.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == want
    assert sum(map(len, want)) < sum(len(t or "") for _, t in texts)
    assert suffix.remove_repeats(nothing).count() == 0


def _byte_rows(raw, length=400):
    rows = []
    for t, spans in zip(raw, brute_spans(raw, length)):
        rows.append((len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(suffix.cut(t, spans)).hexdigest()))
    return rows


def test_suffix_query_equals_brute_force_in_bytes(spark, texts, tmp_path):
    """The registered columns; strings that polynomial hashes modulo 2**64 can't tell apart; null ids and columns more."""
    morse = "".join("ab"[i.bit_count() % 2] for i in range(256))
    other = morse.translate(str.maketrans("ab", "ba"))
    filler = "".join(map(chr, np.random.default_rng(8).integers(0x61, 0x7B, 144)))
    more = [(None, morse + filler), (None, other + filler), (901, "x" + morse + filler[:100]), (902, "é" * 500), (903, "z" + "é" * 230), (904, "ab" * 700), (905, "ab" * 700 + "q")]
    rows = [*texts, *more]
    spark.createDataFrame([(i, t, "en", i) for i, t in rows], "doc_id long, text string, lang string, n_bytes long").write.parquet(str(tmp_path / "documents.parquet"))
    got = suffix.op5_suffix_repeats(spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted((r[0] is None, r[0] or 0, *r[1:5]) for r in got.collect())
    raw = [(t or "").encode() for _, t in rows]
    assert got == sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, _byte_rows(raw)))


def _spans_in_process(raw, length, buckets, batch=3):
    import pyarrow as pa

    class Shared:
        value = substring.Sketch([r for b in substring._merge(sorted_rows(suffix._sketch(length)([pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["text"])]))) for r in b.to_pylist()])

    sent = []
    for i in range(0, len(raw), batch):
        n = len(raw[i : i + batch])
        ids = pa.array(range(i, i + n), pa.int64())
        for b in suffix._pieces(Shared, length, buckets)([pa.RecordBatch.from_arrays([pa.array(raw[i : i + batch], pa.binary()), ids, ids], names=["text", "k1", "k2"])]):
            sent += b.to_pylist()
    sent.sort(key=lambda r: r["bucket"])
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist(sent)] if sent else []
    return sent, [r for b in suffix._repeats(length, buckets)(batches) for r in b.to_pylist()]


def sorted_rows(batches):
    import pyarrow as pa

    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["slice"])
    return [pa.RecordBatch.from_pylist(rows, pa.schema([("slice", pa.int32()), ("what", pa.int64()), ("cells", pa.binary())]))]


@pytest.mark.parametrize("seed", range(3))
def test_suffix_parts_equal_brute_force(seed, monkeypatch):
    """Texts of repeated fragments, long ones read in chunks, by whatever buckets."""
    monkeypatch.setattr(suffix, "SLICE_BYTES", 700)
    rng = np.random.default_rng(seed)
    parts = [bytes(rng.integers(97, 97 + rng.integers(1, 26), rng.integers(150, 420)).astype(np.uint8)) for _ in range(12)]
    raw = [b"".join(parts[k] for k in rng.integers(0, 12, rng.integers(0, 9))) for _ in range(14)]
    length = 300
    for buckets in (1, 3):
        _, marks = _spans_in_process(raw, length, buckets)
        held = exchange.Marks([tuple(r[p] for p in exchange.PARTS) for r in marks])
        assert [suffix._union(*held.of(i, i)) for i in range(len(raw))] == brute_spans(raw, length)


def test_repeat_groups_hold_all_places(spark, documents, texts):
    rows = suffix.repeat_groups(documents).collect()
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, []).append((t or "").encode())
    groups = {}
    for r in rows:
        groups.setdefault((r["group"], r["length"]), []).append((r["doc_id"], r["start"]))
    assert groups
    for (_, n), places in groups.items():
        found = [{t[a : a + n] for t in by_id[i] if len(t) >= a + n} for i, a in places]
        assert len(places) > 1 and n >= 400 and set.intersection(*found)


@pytest.mark.parametrize("seed", range(4))
def test_maximal_repeats_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("ab"), rng.integers(5, 40))).encode() for _ in range(6)]
    length = 5
    places: dict[bytes, list] = {}
    for d, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i + length, len(t) + 1):
                places.setdefault(t[i:j], []).append((d, i))
    want = []
    for s, at in places.items():
        left = {texts[d][i - 1] if i else (d, "start") for d, i in at}
        right = {texts[d][i + len(s)] if i + len(s) < len(texts[d]) else (d, "end") for d, i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            want.append((len(s), sorted(at)))
    assert suffix.maximal_repeats(texts, length) == sorted(want)


def test_fingerprints_and_components(spark, documents, texts, nothing):
    def brute(text):
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        if not words:
            return 0
        n = min(4, len(words))
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [brute(t) for _, t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    ids = {r: [texts[i][0] for i in range(len(texts)) if root[i] == r and texts[i][0] is not None] for r in root}
    want = sorted((texts[i][0] is None, texts[i][0] or 0, f"{prints[i]:016x}", min(ids[root[i]])) for i in range(len(texts)))
    found = simhash.near_duplicates(documents)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in found.collect())
    assert got == want
    kept = simhash.deduplicate(documents)
    assert kept.columns == documents.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(x) for x in ids.values())
    assert simhash.deduplicate(nothing).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_ball_hashing_keeps_components(limit):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30, 3)).astype(np.uint64), axis=1) for c in centre] + [centre]))
    lead = 2
    edges = np.concatenate([simhash.star_edges(fps, p, lead, 2, limit) for p in range(1 << lead)])
    assert (np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= 4).all()

    def roots(pairs):
        up = {x: x for x in fps.tolist()}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return {x: find(x) for x in up}

    near = [(a, b) for a in fps.tolist() for b in fps.tolist() if a < b and (a ^ b).bit_count() <= 4]
    assert roots(map(tuple, edges.tolist())) == roots(near)


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (100, 101)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    hub = [(500, i) for i in range(3000) if i != 500] + [(4000, 4001)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(hub, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {4000: 4000, 4001: 4000}


@pytest.mark.parametrize(("pairs", "most"), [([], 0), ([(2, 1), (1, 3), (7, 5), (4, 4)], 0), ([(1, 2), (2, 3)], 1), ([(i, i + 1) for i in range(4)], 2)])
def test_components_take_no_round_that_changes_nothing(spark, monkeypatch, pairs, most):
    from vectrail.llm import components

    rounds = []
    monkeypatch.setattr(components, "_star", lambda edges, large, total, f=components._star: rounds.append(large) or f(edges, large, total))
    got = dict(components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    root = {x: x for pair in pairs for x in pair if pair[0] != pair[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root and rounds.count(True) <= most


def test_spread_join_deals_a_hot_key(spark):
    rows = [(1 if i % 3 else i, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, v long")
    look = df.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    found = spread_join(df, look.filter("k != 3"), "k", "n", len(rows))
    assert sorted(found.columns) == ["k", "top", "v"]
    top = {k: v for k, v in rows}
    assert sorted((r["k"], r["v"], r["top"]) for r in found.collect()) == sorted((k, v, top[k]) for k, v in rows if k != 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        sizes = spread_join(df, look, "k", "n", len(rows)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(r["count"] for r in sizes) < 300  # of 4,000 rows of the hot key
    assert spread_join(df.limit(0), look.limit(0), "k", "n", 0).count() == 0


def test_copies_and_giant_components(spark):
    words = [f"w{i}" for i in range(400)]
    same = " ".join(words)
    rows = [(i, same) for i in range(900)] + [(900 + i, " ".join([*words[:399], f"x{i}"])) for i in range(900)] + [(None, same), (5000, "alone " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    linked = [r for r in found if r["component_id"] == 0]
    assert {r["doc_id"] for r in linked} >= {None, *range(900)}
    prints = {r["fp"] & (2**64 - 1) for r in linked}
    assert all(any((r["fp"] & (2**64 - 1) ^ p).bit_count() <= 4 for p in prints) == (r["component_id"] == 0) for r in found)
    assert simhash.deduplicate(docs).count() == len({r["component_id"] for r in found})


def test_token_files(spark, documents, texts, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    where = shared_table_path(spark, "ids")
    repair.write_ids(documents, where, tokenizer=path)
    got = repair.read_ids(spark, where).orderBy("start").collect()
    hashes = {(r[0], r[1]): r[2] for r in documents.select("doc_id", "text", F.xxhash64("doc_id", "text")).collect()}
    tokenizer, start = Tokenizer.from_file(path), 0
    for row, (i, t) in zip(got, sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r])), strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(row) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = shared_table_path(spark, "ids")
    repair.write_ids(nothing, empty, tokenizer=path)
    assert repair.read_ids(spark, empty).count() == 0


def test_grammar_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (50, 3), (20_000, 40), (5_000, 50_257)):
        ids = rng.integers(0, top, n).astype(np.uint16)
        ids[: n // 2] = np.resize(ids[: max(1, n // 20)], n // 2)
        cuts = np.unique(np.append(rng.integers(1, n + 1, 9), n))
        sizes = np.diff(np.concatenate([[0], cuts]))
        raw = repair.compress(ids, sizes)
        block = repair.Block(raw)
        assert (block.all() == ids).all() and (block.sizes == sizes).all()
        for k in range(len(sizes)):
            assert (block.document(k) == ids[cuts[k] - sizes[k] : cuts[k]]).all()
        for lo, hi in ((0, 1), (n // 3, n // 3 + 1), (0, n), (n - 1, n)):
            assert (block.range(lo, hi) == ids[lo:hi]).all()
    assert repair.Block(repair.compress(np.tile([1, 2, 3, 4], 2000).astype(np.uint16), np.array([8000]))).length < 40
    with pytest.raises(ValueError):
        repair.Block(b"nope")


def test_encoder_equals_the_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = ["it's  a 'test' don't!!'s\n\n x", None, "", "a<|endoftext|>b", "  lead\t\ttab 123 4½ 　 z", "é'll", "\n", "x \n y  ", "日本語 テスト、ok", "  nb\x1c\x85 ₂²"]
    encoder, library, at = repair.Encoder(path), Tokenizer.from_file(path), 0
    for _ in range(2):
        ids, sizes = encoder.encode(*binary_parts(pa.array(rows)))
        at = 0
        for t, n in zip(rows, sizes):
            assert ids[at : at + n].tolist() == library.encode(t or "", add_special_tokens=False).ids
            at += n
        encoder._shrink()


def test_gumbel_top_k_draws_paths_by_their_probabilities():
    import public_tokenizers
    import pyarrow as pa

    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)

    def paths(x):
        if not x:
            return [((), 0.0)]
        out = []
        for n in range(1, min(len(x), v.longest) + 1):
            h = np.zeros(1, np.uint64)
            for c in x[:n]:
                h = v.step(h, np.array([ord(c)], np.uint32))
            k = int(v.find(h)[0])
            if k >= 0 and v.ids[k] >= 0:
                out += [((int(v.ids[k]), *p), v.weights[k] + q) for p, q in paths(x[n:])]
        return out

    word = "there on"
    every = paths(pieces.MARK + word.replace(" ", pieces.MARK))
    weight = np.array([w for _, w in every])
    p = dict(zip([x for x, _ in every], np.exp(weight) / np.exp(weight).sum()))
    n = 4000
    raw, off = binary_parts(pa.array([word] * n))
    got = pieces.sample_texts(v, raw, off, np.random.default_rng(0).integers(0, 1 << 63, n, dtype=np.uint64), 3)
    assert all(len({tuple(s[0].tolist()) for s in rows}) == 3 and rows[0][2] >= rows[1][2] >= rows[2][2] for rows in got)
    assert all(abs(np.log(p[tuple(s[0].tolist())]) - s[1]) < 1e-9 for rows in got for s in rows)
    for path in sorted(p, key=p.get)[-3:]:
        first = np.mean([tuple(rows[0][0].tolist()) == path for rows in got])
        second = np.mean([tuple(rows[1][0].tolist()) == path for rows in got])
        assert abs(first - p[path]) < 0.03
        assert abs(second - sum(q * p[path] / (1 - q) for s, q in p.items() if s != path)) < 0.03
    # the inclusion scores make an unbiased estimate of a sum over all paths
    total = np.mean([sum(np.exp(s[1]) / s[3] for s in rows) for rows in got])
    assert abs(total - 1) < 0.05


def test_samples_are_decoded_together_and_scored_by_their_slots():
    import public_tokenizers
    import pyarrow as pa

    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    texts = ["", None, "there on", " ", "x" * 700 + " ▁é中\U0001f600", "it's  «quoted»\n\n 123 4½", ""]
    raw, off = binary_parts(pa.array(texts))
    got = pieces.sample_texts(v, raw, off, np.arange(7, dtype=np.uint64), 3)
    ids = [s[0] for rows in got for s in rows]
    own = [(t or "").encode() for t, rows in zip(texts, got) for _ in rows]
    counts = np.array([len(x) for x in ids])
    assert v.decode_each(np.concatenate(ids), counts) == [v.decode_bytes(x) for x in ids] == own
    assert v.decode_each(np.zeros(0, np.int32), np.zeros(2, np.int64)) == [b"", b""]
    # a place's others together are all but one slot, whatever is barred
    lat = v.lattice
    at = np.flatnonzero(lat.last.all > 1)[:50]
    p = lat.padded(at)
    assert np.allclose(p.sum(axis=0), 1)
    assert np.allclose(np.exp(lat.others(at, np.zeros(len(at), np.int64), np.where(np.arange(len(at)) % 2, 2, 0))), 1 - p[0] - np.where(np.arange(len(at)) % 2, p[1], 0))
    assert sum(c.held.itemsize for c in vars(lat).values() if isinstance(c, pieces.Column) and len(c) == len(lat.ids)) == 21


def test_segmentations_of_documents(spark, documents, texts, nothing):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    v = pieces.vocabulary(model, 1.0)
    rows = pieces.sample_segmentations(documents, model, k=3).collect()
    again = pieces.sample_segmentations(documents.repartition(1), model, k=3).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["rank"], r["ids"], r["log_prob"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(v.decode(r["ids"]) if r["ids"] else "")
        assert 0 <= r["inclusion"] <= 1 and r["n_pieces"] == len(r["ids"])
    for i, t in texts:
        assert (t or "") in by_doc[i]
    assert len(by_doc[7]) == len(by_doc[8]) == 1
    assert pieces.sample_segmentations(nothing, model).count() == 0


def test_toxicity(spark, nothing):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        own = [str(w) for w in rng.choice(words, 40)] + (["vexxqu" + str(rng.choice(["a", "os", "ent"])) for _ in range(4)] if toxic else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own), 2.0))
        labels.append((i, int(toxic)))
    rows += [(5000, None, 0.0), (5001, "", 0.0), (5002, "!!", 0.0), (None, "vexxqua", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (0, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    scored, name = toxicity.score(docs, model)
    assert name != "score" and scored.columns[:3] == docs.columns
    got = {r["doc_id"]: r[name] for r in scored.collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all((got[i] >= 0.3) == (i % 5 == 0) for i in held)
    assert all(0 <= x <= 1 for x in got.values()) and got[5000] == got[5001] == got[5002] == model.share
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and 100 < kept.count() < len(rows)
    none = toxicity.train(docs, known.limit(0))
    assert {r[1] for r in toxicity.score(docs, none)[0].select("doc_id", name).collect()} == {0.0}
    assert toxicity.drop_toxic(docs.limit(0), known).count() == 0


def test_kneser_ney_equals_its_definition(spark):
    """Log ratios of the interpolated probabilities, from counts by hand: class counts on top, shared continuation counts below."""
    toxic, plain, order, d = ["bad badly", "sad bad"], ["good sad", "a bag goods"], 4, 0.75
    rows = [(i, t, y) for i, (t, y) in enumerate([(t, 1) for t in toxic] + [(t, 0) for t in plain])]
    own = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 in (0, 3)]
    rows = [(own[i], t, y) for i, t, y in rows]
    model = toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int"))
    grams = lambda w: [x[i : i + order] for x in [(" " + w + " ").ljust(order)] for i in range(len(x) - order + 1)]
    counts = [{}, {}]
    for _, t, y in rows:
        for w in t.split():
            for g in grams(w):
                counts[y][g] = counts[y].get(g, 0) + 1
    kinds = {order: set(counts[0]) | set(counts[1])}
    cont: dict[int, dict] = {}
    for m in range(order - 1, 0, -1):  # of how many longer ones each is the end
        cont[m] = {}
        for g in kinds[m + 1]:
            cont[m][g[1:]] = cont[m].get(g[1:], 0) + 1
        kinds[m] = set(cont[m])

    def lower(g):
        m = len(g)
        if not m:
            return 1 / 256
        row = {x: n for x, n in cont[m].items() if x[:-1] == g[:-1]}
        total = sum(row.values())
        return (max(row.get(g, 0) - d, 0) + d * len(row) * lower(g[1:])) / total if total else lower(g[1:])

    def p(y, g):
        row = {x: n for x, n in counts[y].items() if x[:-1] == g[:-1]}
        total = sum(row.values())
        return (max(row.get(g, 0) - d, 0) + d * len(row) * lower(g[1:])) / total if total else lower(g[1:])

    words = ["bad", "goods", "sad", "bags", "sab", "baz"]
    want = [sum(np.log(p(1, g) / p(0, g)) for g in grams(w)) for w in words]
    assert np.allclose(model.word_ratios([w.encode() for w in words]), want)


def test_toxicity_scores_with_every_ngram(spark):
    """More n-grams than one block of 2**20 holds, and blocks of any size give the same scores."""
    rng = np.random.default_rng(3)
    raw = rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8), (40, 15_000, 8))
    rows = [(i, " ".join(bytes(w).decode() for w in x), i % 2) for i, x in enumerate(raw)]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 in (0, 3)][: len(rows)]
    rows = [(i, text, y) for i, (_, text, y) in zip(ids, rows)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int")
    words = [w.encode() for _, text, _ in rows for w in text.split()]
    want = np.unique(toxicity._grams(words, 4)[0])
    assert len(want) > 1 << 20
    model = toxicity.train(docs, known)
    assert (np.sort(np.concatenate([b.value[1] for b in model.blocks])) == want).all()
    few = docs.filter(docs.doc_id.isin(ids[:2]))
    one, many = (toxicity.train(few, known, block_rows=n) for n in (1 << 20, 5000))
    assert len(one.blocks) == 1 and len(many.blocks) > toxicity.KEPT_BLOCKS
    assert (one.word_ratios(words[:5000]) == many.word_ratios(words[:5000])).all() and one.word_ratios(words).any()


def test_toxicity_counts_all_labelled_training_rows(spark):
    """Remainder 1 too, both what calibrates and what is past calibration_rows; remainder 2 never."""
    rows = [(i, f"common words{i % 7} own{i}x", int(i % 3 == 0)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[1][:2]], "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int")
    words = [w.encode() for i, text, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2 for w in text.split()]
    want = np.unique(toxicity._grams(words, 4)[0])
    for most in (50_000, 20):
        model = toxicity.train(docs, known, calibration_rows=most)
        assert model.curve is not None
        assert (np.sort(np.concatenate([b.value[1] for b in model.blocks])) == want).all()


def test_words_keep_their_numbers():
    """Across slices, after forgetting, and for different words of one hash."""
    from vectrail.llm import words as W

    def slice_of(text):
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return chars, np.flatnonzero(np.concatenate([[True], chars[1:] == 32]))

    known = W.Words()
    first, new = known.numbers(*slice_of("ab cd ab efg cd"))
    assert first.tolist()[0] != first.tolist()[2] and first[1] == first[4] and len(new) == 4  # " ab" is not "ab"
    again, new = known.numbers(*slice_of("ab cd hi ab"))
    assert again[0] == first[0] and again[1] == first[1] and again[3] == first[2] and len(new) == 1
    kept = known.shrink(10)
    assert set(kept.tolist()) == {first[0], first[1], first[2]}
    after, new = known.numbers(*slice_of("ab efg cd"))
    assert len(new) == 1 and kept[after[0]] == first[0] and kept[after[2]] == first[1]
    hashes, W.word_hashes = W.word_hashes, lambda chars, starts, sizes: np.full(len(starts), 7, np.uint64)
    try:
        same = W.Words()
        one, _ = same.numbers(*slice_of("ab cd efg cd"))
        two, _ = same.numbers(*slice_of("xy cd"))
        spell = lambda n: "".join(map(chr, same.chars.all[same.ends.all[n] : same.ends.all[n + 1]]))
        assert [spell(n) for n in one] == ["ab", " cd", " efg", " cd"] and [spell(n) for n in two] == ["xy", " cd"]
    finally:
        W.word_hashes = hashes


def test_marks_reach_their_documents():
    k1, k2 = np.array([5, 5, 3, 5], np.int64), np.array([-9, -9, 7, 8], np.int64)
    batch = exchange.pack_marks(k1, k2, np.array([4, 1, 2, 0]), np.array([6, 3, 9, 1]), 1)
    marks = exchange.Marks([tuple(r[p] for p in exchange.PARTS) for r in batch.to_pylist()])
    assert [x.tolist() for x in marks.of(5, -9)] == [[1, 4], [3, 6]]
    assert [x.tolist() for x in marks.of(3, 7)] == [[2], [9]] and len(marks.of(1, 1)[0]) == 0


def test_marks_tell_rows_apart_by_all_bits_of_their_key():
    none = -(1 << 63)
    k1, k2 = np.array([none] * 3, np.int64), np.array([7, 7 + (1 << 32), 7 - (1 << 63)], np.int64)
    batch = exchange.pack_marks(k1, k2, np.array([1, 2, 3]), np.array([4, 5, 6]), 1)
    marks = exchange.Marks([tuple(r[p] for p in exchange.PARTS) for r in batch.to_pylist()])
    assert [marks.of(none, int(x))[0].tolist() for x in k2] == [[1], [2], [3]]
    assert len(marks.of(none, 7 + (1 << 33))[0]) == 0
