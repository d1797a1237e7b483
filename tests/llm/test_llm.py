"""Small cases of every operator against plain versions: nulls, blanks, ties, repeats, empty tables, extra columns."""

import base64
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import embeddings, exact, minhash, ngrams, packing, pieces, quality, suffixes, tokens, warc
from pulsegrid.llm.graph import components
from pulsegrid.llm.queries import tokenizer
from pulsegrid.runtime import Scratch
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Texts with copies, near copies, shared passages, blanks, nulls and long and periodic ones."""
    rng = random.Random(11)
    passage = " ".join(words(rng, 70))
    base = words(rng, 300)
    out = [None, "", " \t\n", "one", "One", "two words", "a b c d e", "A b c d e", "and " * 400, "and " * 120, "ünï \x0b code\x1fx"]
    for i in range(12):
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    for i in range(40):
        out.append(" ".join([*words(rng, rng.randrange(4, 120)), passage if i % 2 else "", *words(rng, rng.randrange(4, 120))]))
    out.append("\n".join(" ".join(words(rng, 12)) for _ in range(900)))
    out += [out[12], out[12].replace(" ", "\n "), out[30]]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    """The texts with columns whose names clash with those of the operators."""
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1) for i, t in texts], DOCS)
    return df.withColumns({"rep": F.lit(1), "n": F.lit(None).cast("int"), "label": F.lit("x"), "kept": F.lit(False)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_minhash(spark, docs, none, texts):
    want = brute.near_duplicates(texts, percent=80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, docs).collect()}
    assert got == want
    assert minhash.near_duplicates(spark, none).count() == 0


def test_minhash_repeated_and_missing_ids(spark):
    rng = random.Random(1)
    a, b = " ".join(words(rng, 40)), " ".join(words(rng, 40))
    near = a + " more"
    rows = [(5, a), (5, b), (5, a), (None, near), (None, b + " more"), (3, "other words"), (None, None), (None, "alone"), (None, "alone")]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == sorted([(5, 36, 5, True)] * 3 + [(-1, 37, 5, False)] * 2 + [(3, 1, 3, True), (-1, 0, -1, True), (-1, 1, -1, True), (-1, 1, -1, True)])


@pytest.mark.parametrize("block", [2, 7, 10**6])
def test_minhash_chain_and_split(spark, monkeypatch, block):
    """Chains, and a template whose copies do not link, in blocks smaller and larger than the groups."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(2)
    shared, rows = words(rng, 60), []
    for i in range(60):
        rows.append((i, " ".join([*shared, *words(rng, 40)])))
    step = words(rng, 200)
    for i in range(60, 90):
        step = [*step[6:], *words(rng, 6)]
        rows.append((i, " ".join(step)))
    template = words(rng, 200)
    for i in range(90, 150):
        copy = list(template)
        for at in rng.sample(range(200), 3 if i % 3 else 1):
            copy[at] = f"x{i}.{at}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, df, percent=85).collect()}
    want = brute.near_duplicates(rows)
    assert got == want and 50 < len({root for _, root in want.values()}) < 150


def test_estimate():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.6, 0.9):
        both = rng.integers(0, 2**64, int(3000 * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, 3000 - len(both), dtype=np.uint64)])) for _ in range(2))
        regs = minhash.registers([a, b])
        true = len(both) / (6000 - len(both))
        assert abs(minhash.estimate(regs[:1], regs[1:], np.array([3000]), np.array([3000]))[0] - true) < 4.5 * math.sqrt(true * (1 - true) / 128) + 0.01


def test_components(spark, monkeypatch):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1060)]
    want = {n: r for n, r in brute.roots({x for p in links for x in p if p[0] != p[1]}, links).items()}
    df = spark.createDataFrame(links, "u long, v long")
    for few in (10**6, 0):
        monkeypatch.setattr("pulsegrid.llm.graph.FEW", few)
        rows = components(Scratch(spark, "test"), df).collect()
        assert len(rows) == len(want) and {r.node: r.root for r in rows} == want
        assert components(Scratch(spark, "test"), df.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.standard_normal(16)
    for i in range(250):
        x = base + 0.06 * rng.standard_normal(16) if i % 2 else rng.standard_normal(16)
        rows.append((i, [float(v) for v in x], i % 3))
    rows += [(300, rows[1][1], 1), (301, [2 * v for v in rows[1][1]], 1), (302, rows[1][1], None), (303, None, 1), (304, [0.0] * 16, 1), (305, [float("nan")] + [1.0] * 15, 1), (306, [None] + [1.0] * 15, 1), (307, [], 1), (308, [float("inf")] + [0.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    good = {i: np.array(x) / np.linalg.norm(x) for i, x, lab in rows if i < 302}
    label = {i: lab for i, _, lab in rows}
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and good[a] @ good[b] >= 0.98]
    root = brute.roots(label, links)
    n = {i: sum(i in p for p in links) for i in label}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_embeddings(spark, df).collect()}
    assert got == {i: (n[i], root[i], root[i] == i) for i in label}
    assert embeddings.near_embeddings(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("run", [16, 512])
def test_embeddings_in_a_cone(spark, monkeypatch, run):
    """Vectors of one narrow cone, more than a window holds, of which few link, and many that are nearly equal."""
    monkeypatch.setattr(embeddings, "RUN", run)
    rng = np.random.default_rng(5)
    middle = rng.standard_normal(32)
    x = middle + 0.32 * rng.standard_normal((700, 32))
    x[600:] = x[0] + 0.002 * rng.standard_normal((100, 32))
    x[500:600] = x[100:200] + 0.16 * rng.standard_normal((100, 32))
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= 0.98, 1)
    links = list(zip(*(k.tolist() for k in np.nonzero(near))))
    root = brute.roots(range(700), links)
    n = near.sum(0) + near.sum(1)
    assert 30 < (n[:600] > 0).sum() < 500
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_embeddings(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert got == {i: (n[i], root[i]) for i in range(700)}


def test_pieces(spark, docs, none, texts):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    parts = ["a", "th", "ing", " ", "  ", "▁", "\n", "\t", "日", "🎈", "é", "\x00", "12", "--", "==", "tion", " the", "́", "(", "));"]
    rng = random.Random(8)
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)] + [" " * 500 + "x" + " " * 70, "orre" * 3000, " \n a", "\n"]
    model = pieces.codec(path)
    for t in odd + [t or "" for _, t in texts]:
        ids = library.encode(t)
        assert model.encode(t) == ids and model.decode(ids) == library.decode(ids) == model.decode_joined(model.encode_joined(t))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(docs, path).collect()}
    assert got == {i: (len(ids := library.encode(t or "")), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in texts}
    assert pieces.round_trip(none, path).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert back == {i: library.decode(library.encode(t or "")) for i, t in texts}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokens(spark, docs, none, texts, name, monkeypatch):
    monkeypatch.setattr(tokens, "LONG_CHARS", 200)
    path = tokenizer(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, path).collect()}
    assert got == {i: (len((t or "").encode()), n := count(t or ""), n > 512) for i, t in texts}
    assert tokens.token_counts(none, path).count() == 0
    counter, cut = tokens.counter(path)
    rng = random.Random(6)
    parts = ["it's", "'ll", " a", "b ", "  ", "\n\n", "12", "é", "🎈", "<|endoftext|>", "!?", "x y", "\t", " Z", "　"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(200)))
        assert sum(counter(tokens.pieces(t) if cut else [t])) == count(t)


def test_exact(spark, docs, none, texts):
    import re

    norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t in texts}
    groups = {}
    for i, t in sorted(norm.items()):
        groups.setdefault(t, []).append(i)
    want = {i: (groups[t][0], len(groups[t]), groups[t][0] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    for upto in (None, -1, 5, 10**9):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(spark, docs, upto).collect()}
        assert got == want
    assert exact.exact_duplicates(spark, none).count() == 0


def test_exact_repeated_and_missing_ids(spark):
    rows = [(1, "a b"), (None, "a  b"), (2, "c"), (2, "d"), (2, "c"), (None, "d"), (3, "d"), (None, "e"), (None, "e"), (None, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("clash")).withColumn("digest", F.lit(0))
    want = sorted([(1, 1, 2, True), (-1, 1, 2, False), (2, 2, 2, True), (2, 2, 2, True), (2, 2, 3, True), (-1, 2, 3, False), (3, 2, 3, False), (-1, -1, 2, True), (-1, -1, 2, True), (-1, 4, 2, False), (4, 4, 2, True)])
    none = lambda x: -1 if x is None else x
    for upto in (None, 0, 1, 2, 9):
        got = exact.exact_duplicates(spark, df, upto).collect()
        assert sorted((none(r.doc_id), none(r.keep_id), r.group_size, r.kept) for r in got) == want


def test_binary_fuse():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        made = exact.BinaryFuse.build(np.concatenate([keys, keys[:1]]))
        assert made.contains(keys).all()
        assert made.contains(rng.integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.01


def test_suffixes(spark, docs, none, texts):
    want = brute.repeated_words(texts)
    got = {i: set() for i, _ in texts}
    for r in suffixes.repeated_passages(spark, docs).collect():
        assert r.earlier_doc_id < r.doc_id and r.end_word - r.start_word >= 50
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert got == want
    assert suffixes.repeated_passages(spark, none).count() == 0
    cut = {r.doc_id: r.text for r in suffixes.without_repeats(spark, docs).collect()}
    assert len(cut) == len(texts)
    for i, t in texts:
        left = [w for k, w in enumerate(brute.WORD.findall(t or "")) if k not in want[i]]
        assert brute.WORD.findall(cut[i] or "") == left and (want[i] or cut[i] == t)


@pytest.mark.parametrize("crowd,parts", [(3, 3), (10**6, 8), (40, 211)])
def test_suffixes_frequent_line(spark, monkeypatch, crowd, parts):
    """A line of 45 words in all documents; pairs far apart share 10 more words, on either side or split over both, or a line held many times."""
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rng = random.Random(5)
    line = words(rng, 45)
    more = [words(rng, 10) for _ in range(30)]
    rows = []
    for i in range(60):
        k = min(i, 59 - i)
        left, right = (more[k], []) if k % 3 == 0 else ([], more[k]) if k % 3 == 1 else (more[k][:5], more[k][5:])
        rows.append((i, " ".join([*words(rng, 30, 10**6), *left, *line, *right, *words(rng, 30, 10**6)])))
    often = words(rng, 26)
    rows += [(60 + j, " ".join(w for k in range(5) for w in [*words(rng, 40, 10**6), *often, *(more[0] + more[1] + more[2] + more[3] if k == 2 + j else [])])) for j in range(2)]
    same = words(rng, 25)  # 25 words common to all, and 53 that two share
    for i in range(40):
        k = [words(random.Random(f"{i % 20}"), 14), words(random.Random(f"r{i % 20}"), 14)]
        rows.append((100 + i, " ".join([*words(rng, 60, 10**6), *k[0], *same, *k[1], *words(rng, 60, 10**6)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: set() for i, _ in rows}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    for r in suffixes.repeated_passages(spark, df.repartition(3)).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == brute.repeated_words(rows)
    assert sum(map(bool, got.values())) >= 51


def test_suffixes_repeated_and_missing_ids(spark):
    rng = random.Random(6)
    passage, other = words(rng, 60), words(rng, 60)
    rows = [(4, " ".join(["a", *passage])), (4, " ".join([*passage, "b"])), (None, " ".join(passage)), (7, " ".join(["c", "d", *passage])), (9, " ".join(other)), (9, " ".join(other)), (8, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, mark int, spans int")
    got = [(r.doc_id, r.earlier_doc_id, r.start_word, r.end_word) for r in suffixes.repeated_passages(spark, df).collect()]
    assert got == [(7, 4, 2, 62)]
    cut = sorted(((r.doc_id or 0, r.text or "") for r in suffixes.without_repeats(spark, df).collect()))
    assert cut == sorted((i or 0, "c d " if i == 7 else t or "") for i, t in rows)


def round_and_round(rng, n, period):
    """``n`` words that repeat the same ``period`` words."""
    return (words(rng, period) * (n // period + 1))[:n]


def test_suffixes_of_short_periods_are_few():
    """Words in a short period: rows for its beginning and end, not for each time it comes again."""
    rng = random.Random(8)
    for period in (1, 2, 3, 20, 40, 50):
        counts = {}
        for n in (600, 6000):
            text = " ".join([*words(rng, 60), *round_and_round(random.Random(period), n, period), *words(rng, 60)])
            batch = pa.RecordBatch.from_pydict({"doc_id": [1], "mark": [1], "text": [text]})
            made = pa.Table.from_batches(suffixes.anchor_batches([batch])).to_pydict()
            wanted = pa.array([[s | crowded for s in made["suffix"]] for crowded in (0, 1)], pa.list_(pa.int64()))
            both = pa.RecordBatch.from_pydict({"doc_id": [1, 1], "mark": [1, 1], "text": [text] * 2, "suffixes": wanted})
            contexts = pa.Table.from_batches(suffixes.context_batches([both]))
            counts[n] = (len(made["suffix"]), contexts["sides"].null_count)
        # the words around differ, and with them a few suffixes
        assert all(abs(a - b) <= c for a, b, c in zip(counts[600], counts[6000], (30, 300))), (period, counts)


@pytest.mark.parametrize("crowd", [3, 10**6])
def test_suffixes_of_short_periods(spark, monkeypatch, crowd):
    """Texts that share words in periods up to, at and over LEAST, in other phases and lengths, and with words between: the stretches of the SQL."""
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rng = random.Random(9)
    rows = []
    for period in (1, 2, 3, 7, 24, 25, 26, 49, 50, 51, 75, 120):
        for n in (49, 50, 55, 130, 400):
            turn = round_and_round(random.Random(period), n + period, period)[rng.randrange(period) :][:n]
            rows.append((len(rows), " ".join([*words(rng, rng.randrange(30), 10**6), *turn, *words(rng, rng.randrange(60), 10**6), *(turn if n == 130 else []), *words(rng, 5, 10**6)])))
    seen, want = {}, []
    for i, text in rows:
        grams = [tuple(w) for w in zip(*(text.split()[k:] for k in range(50)))]
        for at, g in enumerate(grams):
            if seen.setdefault(g, i) < i:
                old = next((x for x in reversed(want) if x[:2] == [i, seen[g]] and x[3] >= at), None)
                if old:
                    old[3] = at + 50
                else:
                    want.append([i, seen[g], at, at + 50])
    n = 530_000  # more words than an extent has bits for
    rows += [(1000 + i, f"{i}x " + "round " * n) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted([r.doc_id, r.earlier_doc_id, r.start_word, r.end_word] for r in suffixes.repeated_passages(spark, df).collect())
    assert len(want) >= 40 and got == sorted([*want, [1001, 1000, 1, n + 1]])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_ngrams(spark, docs, none, texts, order, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(ngrams, "PART_GRAMS", 500)
    got = {r.doc_id: r for r in ngrams.backoff_scores(spark, docs, order).collect()}
    for i, (n, score) in brute.backoff_scores(texts, order).items():
        assert got[i].n_words == n and math.isclose(got[i].log_score, score, rel_tol=1e-9, abs_tol=1e-9)
        assert (got[i].mean_log_score is None) == (n == 0)
    assert ngrams.backoff_scores(spark, none, order).count() == 0


def test_packing(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 5, 40, 90, 100, 250, None]), rng.choice(["a", "b", "c", None]), rng.choice(["p", "q", f"u{i}", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, length long, source string, cluster string").withColumn("bin", F.lit("clash"))
    got = packing.pack(spark, df, 100).collect()
    length = {i: n or 0 for i, n, *_ in rows}
    kind = {i: (s, c) for i, _, s, c in rows}
    assert {i: sum(r.length for r in got if r.doc_id == i) for i in length} == length
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for items in bins.values():
        assert sum(r.length for r in items) <= 100
        for k in (0, 1):
            held = [kind[r.doc_id][k] for r in items if kind[r.doc_id][k] is not None]
            assert len(held) == len(set(held))
    assert packing.pack(spark, df.limit(0), 100).count() == 0


@pytest.mark.parametrize("frequent", [0, 2, 8])
def test_best_fit_is_tightest(monkeypatch, frequent):
    monkeypatch.setattr(packing, "FREQUENT", frequent)
    rng = random.Random(3)
    items = sorted(((rng.randrange(1, 60), rng.choice("aaaabc") if k % 3 else None, rng.randrange(9) if k % 5 else None) for k in range(400)), key=lambda x: -x[0])
    rooms, held, want = [], [], []
    for n, s, c in items:
        fit = [(rooms[b], b) for b in range(len(rooms)) if rooms[b] >= n and s not in held[b] and c not in held[b]]
        if fit:
            b = min(fit)[1]
        else:
            b = len(rooms)
            rooms.append(60)
            held.append(set())
        rooms[b] -= n
        held[b] |= {s, c} - {None}
        want.append(b)
    assert packing.best_fit(*(list(x) for x in zip(*items)), 60) == want


def test_packing_long_items_ties_and_missing_ids(spark):
    rows = [(1, 10_050, "a", "p"), (2, 50, "b", "q"), (2, 50, "b", "q"), (None, 50, "c", None), (None, 50, "d", None), (3, -4, "a", None), (4, 100, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, length long, source string, cluster string")
    got = packing.pack(spark, df, 100).collect()
    assert sorted((r.doc_id or 0, r.part, r.length) for r in got) == sorted([(1, p, 100 if p < 100 else 50) for p in range(101)] + [(2, 0, 50)] * 2 + [(0, 0, 50)] * 2 + [(3, 0, 0), (4, 0, 100)])
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert len(bins) <= 104 and all(sum(r.length for r in x) <= 100 for x in bins.values())
    assert not [x for x in bins.values() if sum(r.doc_id == 2 for r in x) > 1]
    again = packing.pack(spark, df.repartition(5), 100).collect()
    key = lambda r: (r.doc_id or 0, r.part, r.length, r.shard)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "ü\r\n\r\nWARC/1.1\r\n", "x" * 400_000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://e/{i}\r\nX: y" if i else None, h) for i, h in enumerate(html)], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    digest = [base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for h in html]
    last = {d: i for i, d in enumerate(digest)}
    want = {i: (len((h or "").encode()), d, "response" if last[d] == i else "revisit", None if last[d] == i else last[d]) for i, (h, d) in enumerate(zip(html, digest))}
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, pages).collect()}
    assert got == want
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0
    warc.register(spark)
    path = str(tmp_path / "a")
    warc.to_records(Scratch(spark, "test"), pages).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'")
    assert read.count() == 3 and all(r.payload is None for r in read.collect())
    assert "Filter (" not in read._jdf.queryExecution().executedPlan().toString()  # the source took it


def test_warc_repeated_and_missing_ids(spark):
    rows = [(1, "x"), (1, "x"), (2, "y"), (1, "y"), (None, "x"), (None, "z"), (None, "z"), (3, None), (2, "")]
    pages = spark.createDataFrame([(i, "http://e", h) for i, h in rows], "page_id int, url string, html string")
    for least in (0, 1):
        got = warc.archive_round_trip(spark, pages, least).collect()
        none = lambda x: -1 if x is None else x
        empty = [(3, 0, "response", -1), (2, 0, "response" if least else "revisit", -1 if least else 3)]
        want = [(1, 1, "response", -1)] * 2 + [(2, 1, "response", -1), (1, 1, "revisit", 2), (-1, 1, "revisit", 1)] + [(-1, 1, "response", -1)] * 2 + empty
        assert sorted((none(r.page_id), r.payload_bytes, r.record_type, none(r.refers_to)) for r in got) == sorted(want)


def test_warc_files(spark, tmp_path):
    """Gzip members, predicates on every pushed header, files over tasks, overwriting, and attempts that fail."""
    import gzip
    import os

    warc.register(spark)
    pages = spark.createDataFrame([(i, f"http://e/{i % 2}", "h" * (1000 * (i % 5))) for i in range(20)], "page_id long, url string, html string")
    records = warc.to_records(Scratch(spark, "test"), pages)
    path = str(tmp_path / "w")
    records.repartition(3).write.format("warc").mode("append").save(path)
    records.limit(5).write.format("warc").mode("append").save(path)
    load = lambda **o: spark.read.format("warc").options(**o).load(path)
    assert load().count() == 25 and load(bytesPerTask="1").rdd.getNumPartitions() == len(os.listdir(path)) >= 4
    records.write.format("warc").mode("overwrite").save(path)
    rows = load().collect()
    assert len(rows) == 20 and all(f.endswith(".warc") for f in os.listdir(path))
    one = next(r for r in rows if r.record_type == "revisit")
    for column in ("record_id", "target_uri", "payload_digest", "refers_to"):
        got = load(payload="false").filter(F.col(column) == one[column])
        assert got.count() == sum(r[column] == one[column] for r in rows)
        assert "Filter (" not in got._jdf.queryExecution().executedPlan().toString()
    assert load().filter(F.col("record_type").isin("revisit") & F.col("refers_to").isNotNull() & (F.col("payload_length") > 0)).count() == sum(r.record_type == "revisit" and r.payload_length > 0 for r in rows)
    plain = b"".join(open(os.path.join(path, f), "rb").read() for f in sorted(os.listdir(path)))
    os.makedirs(tmp_path / "z")
    half = plain.index(b"WARC/1.1", len(plain) // 2)
    with open(tmp_path / "z" / "a.warc.gz", "wb") as file:
        file.write(gzip.compress(plain[:half]) + gzip.compress(plain[half:]))
    key = lambda r: (r.record_id, r.payload)
    assert sorted(map(key, spark.read.format("warc").load(str(tmp_path / "z")).collect()), key=str) == sorted(map(key, rows), key=str)
    bad = records.withColumn("payload_length", F.when(F.col("record_id").endswith(":7"), F.raise_error(F.lit("stop")).cast("long")).otherwise(1))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("warc").mode("append").save(path)
    assert load().count() == 20  # files of attempts that end later do not count either


def test_quality(spark, none):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        good = words(rng, rng.randrange(20, 80), 300)
        kind = i % 6
        if kind == 0:
            good = [w.upper() + "!!" for w in good]
        elif kind == 1:
            good[rng.randrange(len(good))] = "nasty"
        rows.append((i, " ".join(good)))
        labels.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, " \n")], "doc_id long, text string").withColumn("expected_grade", F.lit("clash"))
    rated = spark.createDataFrame([x for x in labels if x[0] < 400] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(spark, df, rated).collect()}
    test = [r for r in labels if r[0] >= 400]
    assert np.mean([got[i].kept == (q == 1 and t == 0) for i, q, t in test]) > 0.97
    order = [np.mean([got[i].expected_grade for i, q, t in test if (q, t) == k]) for k in ((0, 0), (1, 1), (1, 0))]
    assert order == sorted(order) and len(got) == 603
    assert all(r.kept for r in quality.classify(spark, df, rated.limit(0)).collect())
    assert quality.classify(spark, none.select("doc_id", "text"), rated).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline as c
    from pyspark.sql import types as T

    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    texts = {r.doc_id: r.text for r in base.collect()}
    after = base
    for _, stage in c.STAGES[1:4]:
        after = stage(spark, after, "/nowhere")
        assert after.columns == base.columns
    left = {r.doc_id: r for r in after.collect()}
    near = brute.near_duplicates([(i, t) for i, t in texts.items()])
    # equal texts went first; of what stayed, one of each component is left
    assert all(i in left or near[i][1] != i or any(brute.WORD.findall(texts[j] or "") == brute.WORD.findall(texts[i] or "") for j in texts if j < i) for i in texts)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left.values())
    bins = c.packed(spark, after, "/nowhere").collect()
    assert {r.doc_id for r in bins} == set(left)
    empty = spark.createDataFrame([], T.StructType(base.schema.fields))
    for _, stage in c.STAGES[1:]:
        assert stage(spark, empty, "/nowhere").count() == 0


def test_pipeline_near_copies_from_80_percent(spark):
    import corpus_pipeline as c

    rng, rows = random.Random(4), []
    for i in range(20):
        base = words(rng, 200)
        copy = list(base)
        for at in (20, 70, 120, 170):
            copy[at] = f"x{i}.{at}"  # 176 of 216 shingles are shared
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows, percent=80)
    assert {r.doc_id for r in c.near(spark, df, "/nowhere").collect()} == {root for _, root in want.values()} == set(range(0, 40, 2))


def test_pipeline_repeated_and_missing_ids(spark):
    """A decision holds for its row only: rows of one doc_id with unlike texts, and rows without one."""
    import corpus_pipeline as c

    rng = random.Random(3)
    a, b, d = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(1, a), (2, b), (2, a), (None, b), (3, d), (3, d), (None, "alone"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(1, a), (2, b), (3, d), (3, d), (None, "alone"), (4, None)]
    assert sorted(((r.doc_id, r.text) for r in c.exact(spark, df, "/nowhere").collect()), key=str) == sorted(kept, key=str)
    df = spark.createDataFrame([(i, t + " more" if t == a and i != 1 or t == b and i is None else t) for i, t in rows], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in c.near(spark, df, "/nowhere").collect()), key=str) == sorted([*kept, (5, "")], key=str)
