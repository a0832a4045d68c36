"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
ODD = [
    (1, "the cat sat on the mat and looked at the dog", "x"),
    (2, "the cat sat on the mat and looked at the dog", "y"),
    (2, "the cat sat on the mat and looked at the dog", "y"),
    (3, None, None),
    (4, "", "x"),
    (5, " \n\t ", "x"),
    (6, "é 漢字 😀 \x00 <|endoftext|>\n\n'tis", "x"),
    (7, "word " * 6000, "x"),
    (8, "x" * 20000, "x"),
    (None, "a null id with mail a.b@c.de and 1.2.3.4", "x"),
    (9, "the cat sat on the mat and looked at the bird", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string").withColumn("part", F.lit(1)).withColumn("n", F.lit(0)).withColumn("bucket", F.lit("b")).withColumn("place", F.lit(1)).withColumn("dropped", F.lit("c")).withColumn("n_lines", F.lit("c")).withColumn("row", F.lit("c")).withColumn("kept", F.lit("c")).withColumn("__text", F.lit("c")).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def test_fingerprints(spark, docs, odd):
    from revlake.llm.fingerprints import Fingerprint, edited, fingerprint_edits

    got = {r.doc_id: r for r in fingerprint_edits(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for d, nxt in zip(order, [*order[1:], order[0]], strict=True):
        new = edited(texts[d], texts[nxt])
        assert got[d].n_chars == len(texts[d])
        assert got[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[d].edited_fingerprint == Fingerprint().add(new).hex()
        assert got[d].fingerprint == Fingerprint().add(texts[d]).hex()
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1
    parts = texts[order[0]].split("\n")
    both = Fingerprint().add("\n".join(parts))
    assert both.hex() == Fingerprint().add("\n".join(reversed(parts))).hex()
    assert Fingerprint().add("a b c\nd").add("e f").remove("d").hex() == Fingerprint().add("e f\na b c").hex()
    # By hand: digests and triples of every paragraph, summed; the likeness is their cosine.
    def plain(text):
        digest, lanes = np.zeros(4, np.uint64), np.zeros(256)
        for p in text.split("\n") if text else []:
            digest = digest + np.frombuffer(hashlib.blake2b(p.encode(), digest_size=32).digest(), "<u8")
            one = Fingerprint().add(p).sketch.astype(np.int16)
            lanes += one
        return digest, lanes

    for d, nxt in zip(order, [*order[1:], order[0]], strict=True):
        new = edited(texts[d], texts[nxt])
        (da, a), (db, b), (_, c) = plain(texts[d]), plain(new), plain(texts[nxt])
        assert got[d].edited_fingerprint[:64] == db.astype("<u8").tobytes().hex() and got[d].fingerprint[:64] == da.astype("<u8").tobytes().hex()
        for x, near, same in ((b, got[d].near_edited, sorted(new.split("\n")) == sorted(texts[d].split("\n"))), (c, got[d].near_next, texts[d] == texts[nxt])):
            size = math.sqrt(a @ a * (x @ x))
            want = 1.0 if same else max(a @ x / size, 0.0) if size else 0.0
            assert abs(near - want) < 1e-8
    edits = [("", "x"), ("\n", "ab\n"), ("\n\n\n", "\nq"), ("a\nb", ""), ("ab\n", "cd\nef"), ("x\n\ny\nz z z z", "k l m n o p")]
    made = spark.createDataFrame([(2 * i + j, t) for i, pair in enumerate(edits) for j, t in enumerate(pair[::-1])], "doc_id long, text string")
    by = {r.doc_id: r for r in fingerprint_edits(made).collect()}
    for i, (t, nxt) in enumerate(edits):
        assert (by[2 * i + 1].fingerprint, by[2 * i + 1].edited_fingerprint) == (Fingerprint().add(t).hex(), Fingerprint().add(edited(t, nxt)).hex())
    rows = fingerprint_edits(odd).collect()
    assert len(rows) == len(ODD) and len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert fingerprint_edits(odd.limit(0)).count() == 0
    one = fingerprint_edits(odd.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_lm_scoring(spark, docs, odd):
    from revlake.llm.lm_scoring import score_documents

    rows = docs.collect()
    got = {r.doc_id: r for r in score_documents(docs).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    pairs = Counter(p for r in rows if not held(r.doc_id) for p in zip(["^", *tokens(r.text)], tokens(r.text), strict=False))
    near = 0
    for r in rows:
        t, g = tokens(r.text), got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r.doc_id), len(t), sum(counts[w] > 0 for w in t), n)
        base = [(counts[w] + 1) / (n + v + 1) for w in t]
        assert math.isclose(g.base_score, sum(map(math.log10, base)), rel_tol=1e-9)
        level = lambda c: 0 if c == 0 else 1.0 if c == 1 else 1.5 * 2 ** (math.floor(math.log2(c))) - 0.5
        exact = 0.0
        for p, w, b in zip(["^", *t], t, base, strict=False):
            c = level(pairs[p, w])
            exact += math.log10((c + 200 * b) / (max(counts[None] if p == "^" else counts[p], c) + 200))
        near += abs(g.score - exact) <= 0.02 * abs(exact)  # the filter's false hits make the difference
    assert near >= 0.97 * len(rows)
    small = {r.doc_id: r for r in score_documents(docs, broadcast_bytes=200_000, chunk_tokens=5000).collect()}
    assert all(math.isclose(small[d].score, got[d].score) and small[d].n_known == got[d].n_known for d in got)
    rows = score_documents(odd).collect()
    assert len(rows) == len(ODD) and all(r.n_tokens == 1 for r in rows if r.doc_id in (3, 4, 5))
    assert score_documents(odd.limit(0)).count() == 0


def test_lm_filter_false_hits():
    import inspect

    from revlake.llm.lm_scoring import Table, build_filter, score_documents

    given = {k: p.default for k, p in inspect.signature(score_documents).parameters.items()}
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(1, 1 << 48, 200_000, dtype=np.uint64))
    bits = build_filter(keys, np.ones(len(keys), np.int64), given["bits_per_key"], given["probes_per_level"])
    found = Table(Table.joined([(0, b"", b"", bits.tobytes())], 0, 1), 1, given["probes_per_level"])
    assert (found.levels(keys) >= 1).all()
    unseen = np.setdiff1d(rng.integers(1, 1 << 48, 200_000, dtype=np.uint64), keys)
    assert (found.levels(unseen) > 0).mean() < 0.01


def test_quality(spark, docs, odd):
    from revlake.llm.quality import fit_quality, keep_quality, score_quality

    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = fit_quality(big, labels)
    held = score_quality(big, model).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    # Same model from plain numpy.
    from revlake.llm.quality import QuadraticDiscriminant, character_classes, statistics

    y = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    x = {k: np.array([statistics(r.text, character_classes()) for r in big.collect() if y.get(r.doc_id) == k]) for k in (0, 1)}
    plain = QuadraticDiscriminant.fit(np.array([len(x[0]), len(x[1])], float), np.array([x[0].sum(0), x[1].sum(0)]), np.array([x[0].T @ x[0], x[1].T @ x[1]]), 0.05)
    sample = np.vstack([x[0][:20], x[1][:20]])
    assert np.allclose(model.score(sample), plain.score(sample), atol=1e-6)
    rows = score_quality(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(odd.limit(0), model).count() == 0
    assert keep_quality(odd, model).columns == odd.columns
    empty = fit_quality(odd, labels.limit(0))
    assert {r.score for r in score_quality(odd, empty).collect()} == {0.5}


def near_lines(rows, min_words=8):
    """Dropped line numbers per row by comparing with all earlier lines."""

    def close(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        s, l = sorted((a, b), key=len)
        return any(l[:i] + l[i + 1 :] == s for i in range(len(l)))

    seen, long, out = set(), [], {}
    for d, text in rows:
        gone = []
        for i, line in enumerate((text or "").split("\n")):
            if not line.strip(" "):
                continue
            if line in seen:
                gone.append(i)
                continue
            seen.add(line)
            w = line.split(" ")
            if len(w) >= min_words:
                if any(close(w, o) for o in long):
                    gone.append(i)
                long.append(w)
        out[d] = gone
    return out


def test_line_dedup(spark, docs, odd):
    from revlake.llm.line_dedup import dedup_lines

    base = "one two three four five six seven eight nine ten eleven twelve".split()
    made = [" ".join(base), " ".join([*base[:3], "X", *base[4:]]), " ".join([*base[:6], "new", *base[6:]]), " ".join(base[1:]), " ".join(base[:-1]), " ".join([*base, "a", "b"]), " ".join(reversed(base)), "short line", "short  line", " ".join(base[:7]), "\n".join([" ".join(base), "", "fresh words only here"])]
    rows = [(i, t) for i, t in enumerate(made)] + [(100 + r.doc_id, r.text) for r in docs.collect()]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = near_lines(rows)
    assert {r.row.doc_id: list(r.dropped) for r in got} == want
    for r in got:
        assert r.deduped_text == "\n".join(x for i, x in enumerate(r.row.text.split("\n")) if i not in want[r.row.doc_id])
    rows = dedup_lines(odd).collect()
    assert len(rows) == len(ODD) and dedup_lines(odd.limit(0)).count() == 0
    of = {r.row.doc_id: r for r in rows}
    assert of[3].dropped is None and of[3].deduped_text is None and list(of[1].dropped) == [] and list(of[2].dropped) == [0] and list(of[9].dropped) == [0]


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    from revlake.llm.packing import SumOfSquares, pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for frame in (docs.repartition(3), odd):
        pieces = pack_documents(frame, path).collect()
        texts: dict = {}
        for r in frame.collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        for d, ts in texts.items():
            ids = [*tokenizer.encode(ts[0], add_special_tokens=False).ids, 2]
            own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
            assert sum(p.length for p in own) == len(ids) * len(ts) and {p.doc_tokens for p in own} == {len(ids)}
            for p in own:
                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        sequences: dict = {}
        for p in pieces:
            sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        for s in sequences.values():
            end = 0
            for offset, length in sorted(s):
                assert offset == end and length > 0
                end += length
            assert end <= 4096 and (end & (end - 1)) == 0
    assert pack_documents(odd.limit(0), path).count() == 0
    rng = np.random.default_rng(3)
    level = SumOfSquares(50)
    for size in rng.integers(1, 50, 400):
        n = level.count.copy()
        options = []
        for h in range(0, 51 - size):
            if h and not n[h]:
                continue
            m = n.copy()
            m[h] -= h > 0
            m[h + size] += h + size < 50
            options.append((int((m**2).sum()), -h))
        h = level.choose(int(size))
        assert (min(options)[0], -h) == min(options)
        level.move(h, int(size))


def test_word_tokenizer_is_the_tokenizer():
    from tokenizers import Tokenizer

    from revlake.llm.packing import WordTokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), WordTokenizer(path)
    texts = [f"a{chr(c)}. {chr(c)}, B{chr(c)}'s {chr(c)}9x" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(6)
    texts += ["".join(rng.choice(list("aZß'sİ.,é1 \u0301\u0307·ŉ²<|>-\n\tſŸ漢क़"), int(rng.integers(1, 25)))) for _ in range(20_000)]
    texts += ["<|endoftext|>", "a<|endoftext|>.", "<|startoftext|>x", "<|", "don't we'll İ. ISN'T."]
    for lo in range(0, len(texts), 5000):
        part = texts[lo : lo + 5000]
        want = [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        got = [ids.tolist() for ids in own.encode_all(part)]
        assert [t for t, a, b in zip(part, got, want, strict=True) if a != b] == []


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(nodes, pairs):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard(spark, docs, odd, block):
    from revlake.llm.jaccard_join import jaccard_components

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for g in range(12):  # chains of ever more edits, and texts that share only a passage
        passage = list(rng.choice(words, 60))
        text = list(rng.choice(words, 80))
        for k in range(8):
            text = list(text)
            text[int(rng.integers(len(text)))] = f"e{g}_{k}"
            rows.append((1000 + 20 * g + k, " ".join(text)))
            rows.append((2000 + 20 * g + k, " ".join([*passage, *rng.choice(words, 10 + 5 * k)])))
    rows += [(5000 + i, " ".join(["common line of words here"] + [f"z{j}" for j in range(i % 7)])) for i in range(40)]
    got = {r.doc_id: r for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block).collect()}
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(ids, pairs)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(sets[d]), want[d]) for d in ids}
    if block == 512:
        rows = jaccard_components(odd).collect()
        assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
        assert [r.component_id for r in rows if r.doc_id is None] == [None]
        assert jaccard_components(odd.limit(0)).count() == 0


def test_jaccard_one_id_with_several_texts(spark):
    from revlake.llm.jaccard_join import jaccard_components

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = " ".join([*b.split()[:-1], "other"])
    rows = [(5, a), (5, b), (7, b), (3, near), (9, a), (11, "z " * 30)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (7, 3), (3, 3), (9, 3), (11, 11)} and len(got) == len(rows)


def test_embeddings(spark):
    from revlake.llm.embed_dedup import near_vectors

    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 24))
    for i in range(0, 300, 3):
        x[i + 1] = x[i] + 0.25 * rng.standard_normal(24)
        x[i + 2] = x[i + 1] + 0.3 * rng.standard_normal(24)
    x[600:700] = x[600] + 0.1 * rng.standard_normal((100, 24))
    x[700:710] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, None]), (904, []), (905, [1.0, 0.0]), (906, [2.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).repartition(3)
    got = near_vectors(df)
    assert got.count() == len(rows)
    got = {r.vec_id: r for r in got.collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    pairs = [(int(a), int(b)) for a, b in np.argwhere(s >= 0.9) if a < b] + [(905, 906)]
    want = components(range(907), pairs)
    links = Counter(a for p in pairs for a in p)
    found = sum(r.n_links for d, r in got.items() if d is not None)
    assert found >= 0.999 * 2 * len(pairs)
    assert all(r.n_links <= links[d] for d, r in got.items() if d is not None)
    wrong = [d for d in range(907) if got[d].component_id != want[d]]
    assert not wrong and all(got[d].kept == (want[d] == d) for d in range(907))
    assert near_vectors(df.limit(0)).count() == 0


def test_embeddings_in_large_shards(spark):
    from revlake.llm.embed_dedup import near_vectors

    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 16))
    x[1:3000:2] = x[0:3000:2] + 0.3 * rng.standard_normal((1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, 0)
    links = (s >= 0.9).sum(1)
    found = np.zeros(6000, int)
    for r in near_vectors(df, shards=2).collect():  # graphs, of about 3,000 vectors
        found[r.vec_id] = r.n_links
    assert (found <= links).all() and found.sum() >= 0.995 * links.sum() > 0
    for r in near_vectors(df, shards=2, audit=1.1).collect():  # an audit that no beam passes: compared in full
        found[r.vec_id] = r.n_links
    assert (found == links).all()
    for r in near_vectors(df, shards=2, beam=1, audit=0.0).collect():  # a beam so narrow that many links are found from one end only
        found[r.vec_id] = r.n_links
    assert (found == links).all()
    asked = np.arange(0, 6000, 100)  # recall of stated queries against all rows, by the graph alone
    from revlake.llm.hnsw import Graph

    got = Graph(unit.astype(np.float32)).within(unit[asked].astype(np.float32), 0.9, 32)
    assert len(got[0]) >= 0.9 * int((unit[asked] @ unit.T >= 0.9).sum())


def test_cut_off_vectors_are_found():
    from revlake.llm.hnsw import Graph

    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    for layer in graph.layers:
        layer.links[:] = -1  # no link leads anywhere
    assert graph.recall(0.9, len(x)) < 0.995
    r, c = graph.all_within(x.astype(np.float32), 0.9)
    assert sorted(zip(r.tolist(), c.tolist(), strict=True)) == sorted((int(a), int(b)) for a, b in np.argwhere(x @ x.T >= 0.9))


def test_hits_of_dense_shards_are_bounded():
    """Groups of near copies: no part of the hits is larger than 512 queries by a block, and none is lost."""
    import tracemalloc

    from revlake.llm.embed_dedup import hits, join
    from revlake.llm.hnsw import Graph

    rng = np.random.default_rng(5)
    x = 1 + 0.1 * rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, up, count = Graph(x), np.arange(3000), 0
    tracemalloc.start()
    for r, c in hits(graph, x, 0.9, 32, 256):
        assert len(r) <= 512 * 256
        join(up, r, c)
        count += len(r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == (x.astype(np.float32) @ x.astype(np.float32).T >= 0.9).sum() > 8_000_000 and (up == 0).all()
    assert peak < 100_000_000  # all pairs at once: 16 bytes each, over 128 MB


def test_sentencepiece(spark, docs, odd):
    import sentencepiece

    from revlake.llm.sp_encode import BacktrackingEncoder, encode_documents

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for frame in (docs, odd):
        texts = frame.select("doc_id", "text").collect()
        got = encode_documents(frame, path, digests_only=False).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), r.decoded) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, sp.encode(r.text or ""), sp.decode(sp.encode(r.text or ""))) for r in texts)
        for r in got:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest())
    e = BacktrackingEncoder(path)
    rng = np.random.default_rng(1)
    for _ in range(500):
        text = "".join(rng.choice(list("ab er in▁ \n\téñ漢<s>0123"), int(rng.integers(0, 30))))
        assert e.both(text) == (sp.encode(text), sp.decode(sp.encode(text)))
    for s in {s for r in texts for s in e.segments("▁" + (r.text or "")[:2000].replace(" ", "▁"))}:
        assert e.pieces(s) == e.merge(s)
    assert encode_documents(odd.limit(0), path).count() == 0


def test_sentencepiece_blanks_stops_and_long_runs():
    import time

    import sentencepiece

    from revlake.llm.sp_encode import BacktrackingEncoder

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, e = sentencepiece.SentencePieceProcessor(model_file=path), BacktrackingEncoder(path)
    rng = np.random.default_rng(2)
    texts = [a + " " * n + b for n in (*range(1, 70), 1000) for a in ("", "a", "x.") for b in ("", "w", "the", "漢", "\n", ".", ",x", "▁", "\ufdd0", "🀄")]
    texts += ["".join(rng.choice(list("ab er in▁ \n\té漢<s>0.,  ▁\ufdd0xX'ſ"), int(rng.integers(0, 30)))) for _ in range(5000)]
    for text, (ids, back) in zip(texts, e.encode_all(texts), strict=True):
        assert ([int(i) for i in ids.split(",") if i], back) == (sp.encode(text), sp.decode(sp.encode(text))), text
    pieces = [t for t in e.ids if t.strip("▁")]
    for i, j in rng.integers(len(pieces), size=(5000, 2)).tolist():
        left, right = pieces[i], pieces[j].lstrip("▁")
        if right in e.ids:
            assert e.fits(left, right) == (e.merge(left + right) == [left, right])
    began = time.process_time()
    for text in (" " * 1_000_000, "  " + "y" * 100_000, "ab" * 100_000):
        e.encode(text)
    assert time.process_time() - began < 20


def base_spans(t):
    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            v = int(c) * (2 if i % 2 else 1)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    out = []
    for k, (n, p) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if n == "ip" and any(int(q) > 255 for q in m[0].split(".")) or n == "card" and not (14 <= len(d) <= 19 and luhn(d)) or n == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{n}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii(spark, docs, odd):
    from revlake.llm.pii import estimate, fit_pii, redact_pii, report_pii

    texts = ["a@b.c_x@d.e.f a@@b.c x@y.z..q", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.003.0004 1.2.3.0000000000255", "4539 1488 0343 6467 12-34-5 4539148803436467 4539-1488-0343-6467-", "+1 (443) 555-5793 +12( +1 23456789012345678 +491234567890.", "😀é a.b@c.de 😀 +1 234 567 8901 1.1.1.1", "0" * 30 + " 00000000000000", "x" * 3000 + "@y.zz", "1" * 4000, 'token = "0123456789abcdef0123456789abcdef01234567" here', 'my key: api_key = "0123456789abcdef0123456789abcdef01234567"'] * 3
    rng = np.random.default_rng(4)
    texts += ["".join(rng.choice(list("a1@.- +(2)3é😀5"), 60)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).repartition(3)
    model = fit_pii(frame)
    texts = {r.doc_id: r.text for r in frame.collect()}
    for r in report_pii(frame, model).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_added
    assert any("secret" in r.spans for r in report_pii(frame, model).collect())
    red = {r.doc_id: r.text for r in redact_pii(frame, model).collect()}
    assert red[4] == "😀é [EMAIL] 😀 [PHONE]" and red[0].startswith("[EMAIL][EMAIL]")
    assert report_pii(odd, model).count() == len(ODD) and report_pii(odd.limit(0)).count() == 0
    assert redact_pii(odd, model).columns == odd.columns
    # EM recovers labelers of known reliability.
    truth = rng.random(4000) < 0.4
    votes = Counter()
    for y in truth:
        votes["".join("1" if (rng.random() < (0.9 if y else 0.1)) else "0" for _ in range(4))] += 1
    post = estimate([("k", v, n) for v, n in votes.items()])
    assert post["k:1111"] > 0.95 and post["k:0000"] < 0.05


def test_pii_many_matches(spark):
    import time

    from revlake.llm.pii import CUT, fit_pii, redact_pii, report_pii

    n = 100_000
    texts = [" ".join(f"a{i}@b.de" for i in range(n)), "\n".join(str(100 + i % 900) for i in range(n)), f"{CUT}a@b.de{CUT}1.2.3.4", "4539148803436467 token=abcdefabcdef123 " * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    model = fit_pii(frame)
    rows = {r.doc_id: r for r in report_pii(frame, model).collect()}
    red = {r.doc_id: r.text for r in redact_pii(frame, model).collect()}
    assert time.time() - began < 120
    for d, t in enumerate(texts):
        want = base_spans(t)
        assert rows[d].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in rows[d].spans.split(",") if x)]
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [t[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        assert red[d] == "".join([*out, t[at:]])
    assert rows[0].n_email == n and rows[1].spans == "" and red[1] == texts[1] and "secret" in rows[3].spans


def page(body, host, i):
    return f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a='<p>';</script></head><body><nav><ul><li><a href='/a'>A</a></li></ul></nav>{body}<footer>&copy; {host}</footer></body></html>"


def test_html(spark):
    from revlake.llm.html_extract import extract_pages, infer_wrappers

    rows = []
    want = {}
    for i in range(12):
        paragraphs = [f"Text {i} of   part {j} &amp; more" for j in range(1 + i % 4)]
        article = f"<article><h1>Head {i}</h1>" + "".join(f"<p>{p}" + "</p>" * (j % 2) for j, p in enumerate(paragraphs)) + "</article>"
        side = "<aside>side</aside><div class='ad'>buy</div><div id='comments'><p>reader says</p></div><form><p>f</p></form>"
        rows.append((i, f"http://h.example/{i}", page(side * (i % 2) + article, "h", i)))
        want[i] = "\n".join([f"Head {i}", *(f"Text {i} of part {j} & more" for j in range(1 + i % 4))])
        rows.append((100 + i, f"https://plain.example/{i}", page(f"<div class='x'><p>Menu constant line</p></div><div class='body'><p>Own words {i} go <b>on</b><br>and on</p></div>", "plain", i)))
        want[100 + i] = f"Own words {i} go on\nand on"
    rows += [(500, None, None), (501, "u", ""), (502, "http://h.example/x", "<article>plain <i>in</i>line"), (502, "http://h.example/x", "<article>plain <i>in</i>line")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("text", F.lit("z")).repartition(3)
    got = extract_pages(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    got = {r.page_id: r.text for r in got}
    assert {k: got[k] for k in want} == want and got[500] == got[501] == "" and got[502] == "plain inline"
    assert extract_pages(df.limit(0)).count() == 0
    expressions = {r.host: r.expression for r in infer_wrappers(df).collect()}
    assert "(<aside>#PCDATA</aside>)?" in expressions["h.example"] and "(<p>#PCDATA</p>)+" in expressions["h.example"]
    assert infer_wrappers(df.limit(0)).count() == 0


def subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_html_alignment_against_brute_force(monkeypatch):
    from revlake.llm import html_extract as H

    rng = np.random.default_rng(3)
    for bits in (1 << 27, 20):  # 20: lists are cut in two
        monkeypatch.setattr(H, "BITS", bits)
        H.align.cache_clear()
        for _ in range(400):
            a, b = (tuple(rng.choice(list("abcd"), int(rng.integers(0, 14)))) for _ in range(2))
            pairs = H.align(a, b)
            assert len(pairs) == subsequence(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_html_wrapper_holds_its_pages():
    """Every page's tree parses: each node finds a node of its key."""
    from revlake.llm.html_extract import Page, Tree, expression, merge, parse

    rng = np.random.default_rng(4)

    def body(depth):
        return "".join(f"<{t}>{body(depth - 1) if depth and t != 'p' else 'x'}</{t}>" for t in rng.choice(["div", "p", "section", "ul"], int(rng.integers(1, 5))))

    lost = slots = 0
    for _ in range(60):
        trees = [Page("<main>" + body(2) + "</main><h2>end</h2>").tree for _ in range(5)]
        wrapper = merge(trees)
        assert Tree.load(wrapper.dump()).dump() == wrapper.dump() and expression(wrapper).startswith("<main>") and expression(wrapper).endswith("<h2>#PCDATA</h2>")
        for t in trees:
            to = parse(t, wrapper)
            assert all(t.key[i] == wrapper.key[w] for i, w in enumerate(to) if w >= 0)
            slots += len(t.leaves)
            lost += sum(to[i] < 0 for i in t.leaves)
    assert lost < 0.05 * slots  # where several alignments are longest, another one may be taken than the wrapper was made by
    a, b = (Page(f"<i></i><div>{x}</div><p>t</p>").tree for x in ("<h1>h</h1><ul><li>l</li></ul>", "<ul><li>l</li></ul>"))
    assert expression(merge([a, b])) == "<div>(<h1>#PCDATA</h1>)?<ul><li>#PCDATA</li></ul></div><p>#PCDATA</p>"
    assert expression(Page("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>").tree) == "(<h2>#PCDATA</h2><p>#PCDATA</p>)+"


def test_html_main_text_follows_the_wrapper(spark):
    """Paragraphs of one name: only alignment tells the constant one at the start from the story, behind a group that some pages have."""
    rows, want = [], []
    for i in range(6):
        extra = f"<table><tr><td>Figure {i}</td></tr></table>" if i % 2 else ""
        rows.append(("http://plain.example/", f"<p>Our motto</p><h2>Title {i}</h2>{extra}<p>Story {i}</p><p>More {i}</p><h3>About us</h3><p>We write</p>"))
        want.append("\n".join([f"Title {i}", *([f"Figure {i}"] if extra else []), f"Story {i}", f"More {i}"]))
    assert extracted(spark, rows) == want


def test_html_attributes_comments_and_open_tags(spark):
    html = {
        "<article><p title=it's>Hello world</p><p>don't stop</p></article>": "Hello world\ndon't stop",
        "<article><p class=\"a>b\" x='>'>One</p><p a='b\"c' d=e\"f>Two</p></article>": "One\nTwo",
        "<article><p/>Three<!-- <p>no</p> --><br/>Four</article>": "Three\nFour",
        "<article>5 < 6 &lt; 7 <b>bold</b></article><p>out</p>": "5 < 6 < 7 bold",
        "<article>kept</article><p class=\"never closed><p>gone": "kept",
        "<article>kept<!-- never closed <p>gone": "kept",
        "<article>kept</article><script>var x = '<p>'; </scripty> </script ><p>out</p>": "kept",
        "<div id=comments><p>reader</p></div><div role=main><p>text</p></div>": "text",
        "<article><p>a<![CDATA[b]]>c</p><?php x ?></p x><p>d</article>": "abc\nd",
    }
    assert extracted(spark, [(f"http://h{i}.example/", h) for i, h in enumerate(html)]) == list(html.values())


def test_html_long_pages():
    import time

    from revlake.llm.html_extract import Page, merge, parse

    began = time.process_time()
    rng = np.random.default_rng(9)
    for source in ("<a " * 50_000, "<p>x</p><h2>y</h2>" * 20_000, "<" * 100_000, "<!--" * 50_000, "<p a='" * 50_000, "<div><p>" * 20_000, "<script>" * 50_000, "<li>a" * 50_000, "</x" * 50_000, "<table><tr><td>q" * 5000):
        Page(source)
    tags = ["h2", "p", "ul", "div"]
    a, b = (Page("".join(f"<{t}>x</{t}>" for t in rng.choice(tags, 8000))).tree for _ in range(2))
    parse(a, merge([a, b]))
    assert time.process_time() - began < 60


def extracted(spark, rows):
    from revlake.llm.html_extract import extract_pages

    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(2)
    return [r.text for r in sorted(extract_pages(df).collect(), key=lambda r: r.page_id)]


def test_html_mixed_templates(spark):
    old = [("http://mixed.example/o", page(f"<div class='x'><p>Same on all</p></div><div class='content'><p>Old words {i}</p></div>", "m", i)) for i in range(5)]
    new = [("http://mixed.example/n", page("<div class='x'><p>Same on all</p></div><main><p>New words</p></main>", "m", 9))]
    assert extracted(spark, old + new) == [*(f"Old words {i}" for i in range(5)), "New words"]


def test_html_copies_are_not_boilerplate(spark):
    copies = [("http://copies.example/a", page("<div class='body'><p>One story</p></div>", "c", i)) for i in range(5)]
    varied = [("http://both.example/v", page(f"<div class='x'><p>Same on all</p></div><div class='body'><p>Story {i}</p></div>", "b", i)) for i in range(4)]
    group = [("http://both.example/g", page("<div class='x'><p>Same on all</p></div><section><p>Copied story</p></section>" + f"<div class='ad'>{i}</div>", "b", i)) for i in range(4)]
    assert extracted(spark, copies + varied + group) == ["One story"] * 5 + [f"Story {i}" for i in range(4)] + ["Copied story"] * 4


def test_html_deep_pages(spark):
    rows = []
    want = []
    for depth in (300, 405, 3000):
        for i in range(4):
            down, up = "<div>" * depth, "</div>" * depth
            rows.append((f"http://a{depth}.example/", page(f"{down}<nav><p>Menu</p></nav><article><div><p>Deep {i}</p></div></article><p>beside</p>{up}", "d", i)))
            want.append(f"Deep {i}")
            rows.append((f"http://b{depth}.example/", page(f"{down}<aside><div><p>Aside {i}</p></div></aside><section><p>Same</p></section><div><p>Own {i}</p></div>{up}<p>After {i}</p>", "d", i)))
            want.append(f"Own {i}\nAfter {i}")
            rows.append((f"http://c{depth}.example/", page(f"<article>{down}<p>In {i}</p><div><p>close</p></div><p>Still {i}</p>{up}</article><p>out</p>", "d", i)))
            want.append(f"In {i}\nclose\nStill {i}")
    assert extracted(spark, rows) == want


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline
    from revlake.llm.quality import character_classes, fit_quality, statistics

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    model = fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rows = [(d, t) for d, t in rows if model.score(np.array([statistics(t, character_classes())]))[0] >= 0.7]
    gone = near_lines(rows)
    rows = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])) for d, t in rows if not gone[d] or len(gone[d]) < len(t.split("\n"))]
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    up = components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    kept = {d: t for d, t in rows if up[d] == d}
    assert {p.doc_id for p in pieces} == set(kept)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, t in kept.items():
        if not base_spans(t) and "=" not in t:
            assert {p.doc_tokens for p in pieces if p.doc_id == d} == {len(tokenizer.encode(t, add_special_tokens=False).ids) + 1}


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    for docs in (odd.withColumn("n_chars", F.lit(0).cast("long")), odd.limit(0)):
        count = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "packing":
                assert out.columns == docs.columns, name
                assert out.count() <= count
            else:
                assert (out.count() == 0) == (count == 0)
    kept = corpus_pipeline.line_dedup(spark, odd, SMALL).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id in (1, 2, 3, 4, 9)) == [1, 3, 4]
    kept = corpus_pipeline.near_duplicates(spark, odd.where("doc_id in (1, 2, 3, 4)"), SMALL).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4]
    red = corpus_pipeline.pii(spark, odd, SMALL).where("doc_id is null").first()
    assert red.text == "a null id with mail [EMAIL] and [IP]"
