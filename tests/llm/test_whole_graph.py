"""Trust and distrust reach every host, whatever the scale."""

from loomdex.llm import link_graph


def test_distrust_reaches_every_host(spark):
    """A chain of hosts to a blocked one, each of many links, gives scores under 1e-9 and is longer than 20."""
    chain = [f"h{k}.com" for k in range(24)]
    pages = [(0, "http://spam.net/", "")]
    for k, h in enumerate(chain):
        to = chain[k - 1] if k else "spam.net"
        pages.append((k + 1, f"http://{h}/", f"<a href='http://{to}/'>"))
        pages += [(1000 * (k + 1) + j, f"http://s{k}-{j}.com/", f"<a href='http://{to}/'>") for j in range(4)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = link_graph.judge(rows).collect()
    assert {r.verdict for r in got} == {"block"}
    assert 0 < min(r.distrust for r in got) < 1e-9
