"""Every registered query of the reference's operators against its SQL."""

import pytest

from jobsignal import registry
from tests.oracle import differences, duck


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf_dir):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql is None:
        assert len(query(spark, sf_dir).collect()) > 0
    else:
        assert not differences(spark, name, query, sql, sf_dir, duck(sf_dir))


def test_highlight_later_lines(spark, tmp_path):
    from jobsignal.catalog.texts import WORDS

    rows = [(1, f"Head\nsecond\nthird has {WORDS[0]} in it"), (2, "Head\nsecond\nthird"), (3, "Head")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.marked for r in registry.queries()["x4_highlight"](spark, str(tmp_path)).collect()}
    assert got.get(1) is True and not got.get(2) and not got.get(3)


def test_odd_references(spark, tmp_path):
    texts = ["a &amp b&amp;&amp;lt;i&amp;gt;x", "&am &ampx &notit; &notin; &#65 &#x42;&#x80;&#xD800;&#x110000;&#99999999999999999999;&#0;&#1;&#x", "&nosuch; &;& it's &#39;&apos; &NotEqualTilde;", "v\x0b\x0b w &nbsp; <b>t</b>", None, ""]
    spark.createDataFrame([(i, f"http://h{i % 2}.x/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1).toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    for name in ("n2_clean_html_text", "n2_size_report"):
        assert not differences(spark, name, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path), duck(str(tmp_path)))
