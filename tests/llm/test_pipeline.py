"""The pipeline's stages on the small documents table, each held against plain Python on its own input; and the queries against their SQL."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quadrat.llm import common, packing
from quadrat.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
words = re.compile(r"[^\x20\x09-\x0D]+").findall


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.table(spark, SF, "documents"), {}
    out["documents"] = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), "test")
        out[name] = docs.toPandas()
    return out


def test_columns(stages):
    names = list(stages)
    for name in names[1:-1]:
        assert list(stages[name].columns) == list(stages["documents"].columns)


def test_quality(stages):
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").df()
    kept = set(stages["quality_classifier"].doc_id)
    good, bad = set(labels[labels.quality == 1].doc_id), set(labels[labels.quality == 0].doc_id)
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.1 * len(bad)
    assert stages["quality_classifier"].merge(stages["documents"]).shape[0] == len(kept)


def test_near_duplicates(stages):
    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])

    rows = [(i, shingles(t)) for i, t in stages["quality_classifier"].sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False)]
    group = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, s in rows:
            for b, t in rows:
                if group[b] > group[a] and 5 * len(s & t) >= 4 * len(s | t):
                    group[b], changed = group[a], True
    assert set(stages["ngram_join"].doc_id) == {i for i, g in group.items() if i == g}


def test_repeats(stages):
    seen, want = set(), {}
    for i, t in stages["ngram_join"].sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False):
        b = t.encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            if (w := b[p : p + 100]) in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, m in zip(b, mark) if not m).decode("utf-8", "ignore")
        if words(left):
            want[i] = left
    got = stages["suffix_dedup"]
    assert dict(zip(got.doc_id, got.text)) == want
    assert (got.n_chars == got.text.str.len()).all()


def test_mix(stages):
    before, after = stages["suffix_dedup"], stages["mixing"]
    size = before.text.map(lambda t: len(words(t)))
    assert abs(after.text.map(lambda t: len(words(t))).sum() - size.sum()) <= len(before.source.unique())
    taken, own = Counter(), dict(zip(before.doc_id, size))
    for i, t in after[["doc_id", "text"]].itertuples(index=False):
        taken[i] += len(words(t))
    assert all(n <= 3 * own[i] for i, n in taken.items())
    text = dict(zip(before.doc_id, before.text))
    for i, t in after[["doc_id", "text"]].itertuples(index=False):
        assert not Counter(words(t)) - Counter(words(text[i]))


def test_packing(stages):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.default_tokenizer()).encode
    want = Counter()
    for i, t in stages["mixing"][["doc_id", "text"]].itertuples(index=False):
        ids = [*encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())] += 1
    p = stages["packing"]
    assert Counter(p[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    p = p.sort_values(["sequence_id", "offset"])
    g = p.groupby("sequence_id").length
    assert (g.cumsum() - p.length == p.offset).all() and g.sum().max() <= 2048
    assert p.sequence_id.nunique() <= -(-p.length.sum() // 2048) + 1


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].to_numpy().tolist()), key=repr)
    assert sorted(got.columns) == columns and rows(got) == rows(want)
