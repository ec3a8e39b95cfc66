"""The registered queries against their SQL, and the pipeline against brute force."""

import pytest

import corpus_pipeline
from strandline.llm.queries import ORACLE, QUERIES
from tools.check_catalog import rows_of


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = duck.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, res.fetchall()) and got


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, seen[-1], sf_dir)
        assert out.columns == docs.columns
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))
    toxic, exact, near, clean = rows[1:]
    # exact copies: the largest id of each text
    last = {}
    for i, r in toxic.items():
        last[r.text] = max(i, last.get(r.text, i))
    assert set(exact) == set(last.values())
    # near copies: one of each group, the smallest id
    from strandline.llm.secret_scan import find
    from strandline.llm.simhash import fingerprint

    fp = {i: fingerprint(r.text) for i, r in exact.items()}
    group = {i: i for i in fp}
    for i in sorted(fp):
        for j in sorted(fp):
            if j < i and (fp[i] ^ fp[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    assert set(near) == set(group.values())
    # secrets: gone from texts, other texts as they were
    assert set(clean) == set(near)
    for i, r in clean.items():
        assert not find(r.text)[0]
        if not find(near[i].text)[1]:
            assert r == near[i]
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(clean)
