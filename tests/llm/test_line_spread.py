import collections

import duckdb
import pytest

from docweave.llm.line_spread import remove_boilerplate
from docweave.llm.queries import ORACLES, QUERIES


def plain(rows, min_sites):
    sites = collections.defaultdict(set)
    for text, site in rows:
        for line in (text or "").split("\n"):
            if site is not None and line.strip(" \t\r\x0b\x0c"):
                sites[line.strip(" \t\r\x0b\x0c")].add(site)
    return ["\n".join(x for x in (text or "").split("\n") if len(sites.get(x.strip(" \t\r\x0b\x0c"), ())) < min_sites) for text, _ in rows]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    got = QUERIES["op8_line_spread"](spark, f"/root/testdata/{sf}")
    want = con.execute(ORACLES["op8_line_spread"])
    assert sorted(d[0] for d in want.description) == sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("min_sites", [3, 40, 200])
def test_near_threshold_lines_are_exact(spark, min_sites):
    rows = []
    for i in range(300):
        lines = [f"unique {i}"] + [f"line on {k} sites" for k in (1, min_sites - 1, min_sites, min_sites + 1, 2 * min_sites) if i % 300 < k]
        rows.append(("\n".join(lines) + "\n \n", f"site{i}"))
    rows += [("line on everything hot", "hot")] * 500 + [(f"line on {min_sites - 1} sites", "site0")] * 50
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = [r.text for r in remove_boilerplate(df, min_sites=min_sites).orderBy("doc_id").collect()]
    assert got == plain(rows, min_sites)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = remove_boilerplate(odd_docs, min_sites=1).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted(
        (str(r.doc_id), t) for r, t in zip(rows, plain([(r.text, r.source) for r in rows], 1)))
    assert set(odd_docs.columns) < set(remove_boilerplate(odd_docs).columns)
    assert remove_boilerplate(no_docs).count() == 0


def test_helper_names_in_the_table_survive(spark):
    rows = [(i, "common\nown line %d\ncommon" % i, f"s{i}", "one", "two", "three", i) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _t1 string, _H2 string, _hits string, _t1_ long")
    got = {r.doc_id: r for r in remove_boilerplate(docs, min_sites=3).collect()}
    assert got.keys() == set(range(5))
    assert all((r._t1, r._H2, r._hits, r._t1_, r.text, r.n_removed) == ("one", "two", "three", i, f"own line {i}", 2) for i, r in got.items())


def test_many_hits_in_a_text_take_linear_time(spark):
    import time

    text = "\n".join(f"line {i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, text + f"\nown {i}", f"s{i}") for i in range(12)], "doc_id long, text string, source string")
    began = time.time()
    got = remove_boilerplate(docs, min_sites=10).collect()
    assert sorted(r.text for r in got) == sorted(f"own {i}" for i in range(12)) and all(r.n_removed == 20_000 for r in got)
    assert time.time() - began < 30
