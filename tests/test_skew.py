"""A third of all rows on one paper and on one author: results stay those of DuckDB."""

import shutil
from pathlib import Path

import duckdb
import pytest

from check_oracles import compare, duck

NAMES = ["a14_density_by_group", "d02_author_hindex_delta", "d12_author_rank_per_year", "d13_pagerank_unweighted",
         "d14_pagerank_weighted", "d15_recent_coauthors", "d22_paper_author_hindex", "d35_histories", "m03_plus_k",
         "m04_simple_linear", "m09_log_likelihood", "m16_author_comparison", "s11_citation_graph", "s12_paper_metadata",
         "t03_argmax_row", "x04_gamma_functions", "x05_softplus"]


@pytest.fixture(scope="module")
def skewed(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for f in Path(sf).glob("*.parquet"):
        if f.name != "lineitem.parquet":
            shutil.copy(f, folder / f.name)
    duckdb.connect().execute(f"""COPY (SELECT * REPLACE (
        CASE WHEN l_linenumber % 3 = 0 THEN 7 ELSE l_partkey END::BIGINT AS l_partkey,
        CASE WHEN l_orderkey % 3 = 0 THEN 5 ELSE l_suppkey END::BIGINT AS l_suppkey)
        FROM '{sf}/lineitem.parquet') TO '{folder}/lineitem.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_skewed(spark, skewed, name):
    text, _, ok = compare(spark, duck(skewed), name, skewed)
    assert ok, text
