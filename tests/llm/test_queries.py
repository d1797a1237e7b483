"""The registered queries over whole small tables, against SQL or plain versions."""

import hashlib
import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from pulsegrid.llm import packing, quality
from pulsegrid.llm.queries import ORACLE_SQL, table, tokenizer
from tests.llm import brute
from tests.test_queries import TABLES


@pytest.fixture(scope="module")
def got(spark, small):
    """Rows of a query by name."""
    held = {}

    def rows(name):
        if name not in held:
            held[name] = entry.queries()[name](spark, small).collect()
        return held[name]

    return rows


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r for r in table(spark, small, "documents").collect()}


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(got, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want, rows = con.sql(entry.oracle_sql()[name]), got(name)
    columns = sorted(rows[0].asDict())
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_quality_query(spark, small, got, texts):
    """The model's weights applied by a plain version to plainly made features."""
    model = quality.train(spark, table(spark, small, "documents"), quality.grades(table(spark, small, "labels")), 3)
    rows = {r.doc_id: r for r in got("op2_quality_ordinal")}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        score = sum(model.weights[f] for f in brute.quality_features(texts[i].text))
        tails = [1 / (1 + math.exp(min(60, max(-60, t - score)))) for t in model.thresholds]
        assert math.isclose(r.expected_grade, sum(tails), rel_tol=1e-9) and math.isclose(r.tail_probability, tails[-1], rel_tol=1e-9)
        assert r.kept == (r.tail_probability >= 0.5)


def test_sentencepiece_query(got, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: library.encode(r.text or "") for i, r in texts.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got("op4_sentencepiece_round_trip")} == {i: (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, ids in want.items()}


def test_backoff_query(got, texts):
    want = brute.backoff_scores([(i, r.text) for i, r in texts.items()])
    rows = {r.doc_id: r for r in got("op5_backoff_scores")}
    assert all(rows[i].n_words == n and math.isclose(rows[i].log_score, s, rel_tol=1e-9, abs_tol=1e-9) for i, (n, s) in want.items()) and len(rows) == len(want)


def token_lengths(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    return {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}


def test_token_query(got, texts):
    n = token_lengths({i: r.text for i, r in texts.items()})
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got("op7_token_counts")} == {i: (len((r.text or "").encode()), n[i], n[i] > 512) for i, r in texts.items()}


def packed_well(rows, texts, capacity=2048):
    """All tokens in bins that hold no source and no text twice, as one shard of best fit gives them."""
    n = token_lengths({i: r.text for i, r in texts.items()})
    items, bins = [], {}
    for i, r in texts.items():
        key = re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")
        items += [(i, p, min(capacity, n[i] - p * capacity), r.source, key) for p in range(max(1, -(-n[i] // capacity)))]
    assert sorted((r.doc_id, r.part, r.length) for r in rows) == sorted(x[:3] for x in items)
    kind = {x[:2]: x[3:] for x in items}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for held in bins.values():
        assert sum(r.length for r in held) <= capacity
        for k in (0, 1):
            seen = [kind[r.doc_id, r.part][k] for r in held if kind[r.doc_id, r.part][k] is not None]
            assert len(seen) == len(set(seen))
    items.sort(key=lambda x: (-x[2], x[0], x[1]))
    assert len(bins) == len(set(packing.best_fit(*([x[k] for x in items] for k in (2, 3, 4)), capacity)))


def test_packing_query(got, texts):
    packed_well(got("op10_best_fit_packing"), texts)


def test_pipeline_query(got, texts):
    """Every stage by a plain version on what the plain versions before it kept."""
    keep = {r.doc_id for r in got("op2_quality_ordinal") if r.kept}
    first, left = set(), {}
    for i in sorted(keep):
        key = re.sub(r"[\x20\x09-\x0d]+", " ", texts[i].text or "")
        if key not in first:
            first.add(key)
            left[i] = texts[i].text
    near = brute.near_duplicates(list(left.items()), percent=80)
    left = {i: t for i, t in left.items() if near[i][1] == i}
    gone = brute.repeated_words(list(left.items()))
    kept_words = {i: [w for k, w in enumerate(brute.WORD.findall(t or "")) if k not in gone[i]] for i, t in left.items()}
    rows = got("pipeline")
    assert {r.doc_id for r in rows} == set(left)
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    plain = {i: t for i, t in left.items() if not gone[i]}
    assert {i: total[i] for i in plain} == token_lengths(plain)
    assert any(gone.values()) and all((total[i] == 0) == (not kept_words[i]) for i in left if gone[i] and not (left[i] or "").startswith((" ", "\n")))
