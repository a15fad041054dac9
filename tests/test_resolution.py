"""Requests against a local server with recorded answers, and the completion of stores."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest
from lexiscope.operators import resolution as rs
from lexiscope.sources import payloads
from lexiscope.sources import requests as rq

DOCUMENT = "identifiers map<string,array<string>>, year string, sources array<string>"
FIELDS = {"year": "first_seen", "sources": "set_union"}
JOURNAL = "identifiers map<string,array<string>>, name string, abbreviation string, name_variants array<string>, mesh_topics array<string>"


@pytest.fixture
def server():
    seen, lock = [], threading.Lock()

    class Recorded(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            keys = unquote(self.path.rpartition("=")[2]).split(",")
            with lock:
                again = any(k == keys for k, _ in seen)
                seen.append((keys, time.monotonic()))
            if "13" in keys or ("7" in keys and not again):  # one request never works, one at the second time
                self.send_error(503)
                return
            body = "".join(f"<PubmedArticle><MedlineCitation><PMID Version='1'>{k}</PMID><Article><Journal><JournalIssue><PubDate><Year>{1900 + int(k)}</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>" for k in keys if int(k) % 5)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(f"<PubmedArticleSet>\n{body}</PubmedArticleSet>".encode())

        def log_message(self, *args):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Recorded)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}/fetch?id={{keys}}", seen
    running.shutdown()


def test_requests(spark, server):
    url, seen = server
    keys = spark.createDataFrame([(str(i),) for i in range(40)] * 2 + [(None,)], "value string").repartition(5)
    answers = rq.ask(keys, rq.http_get(url), size=4, spacing=0.05, tries=2, tasks=1)
    rows = answers.collect()
    assert sorted(k for r in rows for k in r["keys"]) == sorted(map(str, range(40))) and {len(r["keys"]) for r in rows} == {4}
    assert {r.tries for r in rows if "7" in r["keys"] and "13" not in r["keys"]} <= {2}
    failed = [r for r in rows if r.body is None]
    assert len(failed) == 1 and "13" in failed[0]["keys"] and failed[0].tries == 2 and "503" in failed[0].error
    assert len(seen) == 10 + sum(r.tries - 1 for r in rows)  # nothing was asked twice by later reads
    assert seen[-1][1] - seen[0][1] >= 0.05 * (len(seen) - 1) - 0.03  # as they arrive, single ones may be late
    found = rq.parsed(answers, payloads.read_pubmed).collect()
    lost = set(failed[0]["keys"])
    assert {r.identifiers["pmid"][0]: r.pub_year for r in found} == {str(i): str(1900 + i) for i in range(40) if i % 5 and str(i) not in lost}
    empty = rq.ask(keys.limit(0), rq.http_get(url), tasks=2)
    assert empty.count() == 0
    with pytest.raises(ValueError, match="1 at least"):
        rq.ask(keys, rq.http_get(url), size=0)


def test_documents_fall_back(spark):
    calls = []

    def service(name, known):
        rows = spark.createDataFrame([({k: [v] for k, v in ids.items()}, year, [name]) for ids, year in known], DOCUMENT)

        def run(wanted):
            calls.append((name, sorted(r.value for r in wanted.collect())))
            kind = "pmid" if name.startswith("p") else "doi"
            flat = rows.selectExpr("*", f"element_at(identifiers, '{kind}')[0] AS value")
            return flat.join(wanted, "value", "left_semi").drop("value")

        return run

    documents = spark.createDataFrame([(1, {"pmid": "1"}), (2, {"pmid": "2", "doi": "b"}), (3, {"doi": "c"}), (4, {"pmid": "4", "doi": None}), (5, None), (6, {"isbn": "x"}), (7, {"pmid": "2"})], "id int, identifiers map<string,string>")
    store = spark.createDataFrame([(9, {"pmid": ["1"]}, "1990", ["store"])], f"record_id long, {DOCUMENT}")
    services = {"pmid": [service("p1", [({"pmid": "2", "doi": "b"}, "2002"), ({"pmid": "8"}, "2008")]), service("p2", [({"pmid": "2"}, "no"), ({"pmid": "5"}, "2005")])], "doi": [service("d1", [({"doi": "b"}, "2999"), ({"doi": "c"}, "2003")])]}
    out, left = rs.complete_documents(documents, store, services, FIELDS)
    assert calls == [("p1", ["2", "4"]), ("p2", ["4"]), ("d1", ["b", "c"])]
    rows = sorted((r.record_id, r.year, tuple(r.sources), {k: tuple(v) for k, v in r.identifiers.items()}) for r in out.collect())
    assert rows == [(9, "1990", ("store",), {"pmid": ("1",)}), (10, "2002", ("p1", "d1"), {"doi": ("b",), "pmid": ("2",)}), (11, "2003", ("d1",), {"doi": ("c",)})]
    assert [tuple(r) for r in left.collect()] == [("pmid", "4")]


def test_journals_by_key_order_and_one_refresh(spark):
    catalogue = [({"nlm": ["N1"], "issn": ["I1"]}, "Heart", "Hrt", None, ["hearts"]), ({"nlm": ["N2"], "issn": ["I2"]}, "Lung", "Lng", ["Lungs!"], None), ({"nlm": ["N3"]}, "Cell", "Cel", None, []), ({"nlm": ["N4"], "issn": ["I4"]}, "Gene", "Gen", None, ["genes"])]
    rows, calls = spark.createDataFrame(catalogue, JOURNAL), []

    def service(kind):
        def run(wanted):
            calls.append((kind, sorted(r.value for r in wanted.collect())))
            key = {"abbreviation": "abbreviation", "name": "name"}.get(kind, f"element_at(identifiers, '{kind}')[0]")
            return rows.selectExpr("*", f"{key} AS value").join(wanted, "value", "left_semi").drop("value")

        return run

    services = {k: service(k) for k in rs.JOURNAL_KEYS}
    infos = spark.createDataFrame([({"nlm": ["N1"]}, None, "HEART"), ({"issn": ["I1", "I9"]}, None, None), (None, " Lng ", "lungs"), ({}, None, "Cell"), ({}, "Dup", None), ({}, "?!", "")], "identifiers map<string,array<string>>, abbreviation string, name string")
    store = spark.createDataFrame([(1, {"nlm": ["N7"]}, "One", "Dup", None, ["t"]), (2, {"nlm": ["N8"]}, "Two", "dup.", None, ["t"])], f"record_id long, {JOURNAL}")
    out = rs.complete_journals(infos, store, services)
    # one name of two records is resolved by none; the name of a record that came by its number isn't asked for
    assert calls == [("nlm", ["N1"]), ("issn", ["I9"]), ("abbreviation", ["?!", "Dup", "Lng"]), ("name", ["Cell"])]
    assert sorted((r.record_id, r.name) for r in out.collect()) == [(1, "One"), (2, "Two"), (3, "Heart"), (4, "Lung"), (5, "Cell")]
    calls.clear()
    out, tried = rs.refresh_journals(out, services["nlm"])
    again, tried = rs.refresh_journals(out, services["nlm"], tried)
    assert calls == [("nlm", ["N2"])] and [r.value for r in tried.collect()] == ["N2"] and again.count() == 5
