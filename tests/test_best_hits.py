"""Pages of hits are settled: a search runs once, and nothing but its hits is read as HTML."""

from pagestrata.functions import urls
from pagestrata.operators import catalog, results
from pagestrata.operators.text_index import TextIndex
from pagestrata.sources import views
from pagestrata.sources.tables import new_path

DATA = "/root/testdata/sf0.001"


def test_page_results_meet_pages_by_semi_joins(spark):
    pages = views.archives(spark, DATA).withColumnRenamed("id", "page_id")
    texts = pages.select("page_id", "title", "body")
    kept = TextIndex.build(texts, new_path(spark), ["page_id"], ["title", "body"])
    known = pages.select("page_id", "title", urls.normalize(pages["final_url"]).alias("norm"))
    found = results.page_results(texts, known, "th on", kept=kept)
    assert not any("/postings/" in f for f in found.inputFiles())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2  # of texts and of pages


def test_library_pages_search_once(spark):
    rows = views.archives(spark, DATA)
    index = TextIndex.build(rows.where("not deleted"), new_path(spark), ["id"], ["title", "final_url", "domain", "body"])
    page = catalog.LibraryQuery(search="th on", limit=20).page(rows, index)
    assert not any("/postings/" in f for f in page.inputFiles()) and page.count() == 20
