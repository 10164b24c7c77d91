"""Pages, conversations, archives and the pipeline."""

import base64
import gzip
import hashlib
import json
import zlib

import duckdb
import pandas as pd
import pytest

from sparkloom.llm import chat, decontaminate, html, jaccard, packing, pii, warc
from sparkloom.llm.common import free_name, fresh_path

# --- archives ------------------------------------------------------------------------------------------------------

NASTY = [gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n").decode("latin-1"), "\x1f\x8b\x08" * 500, "WARC/1.1\r\n\r\n", "", "é😀" * 3000, "plain", "x" * 200_000]


@pytest.mark.parametrize("range_bytes", [37, 1000, 1 << 22])
def test_warc_round_trip(spark, range_bytes):
    rows = [(i, f"http://h/{i}?a b\n", t) for i, t in enumerate(NASTY)] + [(50 + i, None, t) for i, t in enumerate(NASTY[:4])] + [(3, "http://again", ""), (60, "u", None), (None, "u", "only null"), (None, "u", "only null"), (None, "u", "plain"), (61, "u", "once")]
    pages = spark.createDataFrame([(*r, "kept out") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    archives = warc.write_archives(pages, fresh_path(spark, "warc"))
    got = warc.read_archives(archives, range_bytes).collect()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, _, t in rows:
        body = (t or "").encode()
        revisit = (t or "") in first and first[t or ""] != i and sum((x[2] or "") == (t or "") for x in rows) > 1
        want.append((i, "revisit" if revisit else "response", first[t or ""] if revisit else None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), True))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["intact"])) for r in got)
    for r in got:
        if r["record_type"] == "response":
            assert base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["payload_digest"]
    assert {r["url"] for r in got if r["page_id"] == 0} == {"http://h/0?a%20b%0A"}


def test_warc_members_are_read_in_one_range_only(tmp_path):
    record = warc.record("response", 1, "u", b"\x1f\x8b\x08 inside" * 50, "D", None, "x")
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = (stored.compress(record) + stored.flush()) * 7
    (tmp_path / "a.warc.gz").write_bytes(data)
    import pyarrow as pa

    for step in (1, 13, 333, len(data)):
        n = sum(len(list(warc.RangeReader(pa.memory_map(str(tmp_path / "a.warc.gz")), len(data), a, a + step))) for a in range(0, len(data), step))
        assert n == 7
    assert gzip.decompress(data) == record * 7


def test_warc_headers_may_be_long(tmp_path):
    import random

    import pyarrow as pa

    url = "data:text/html," + random.Random(1).randbytes(1 << 20).hex()
    data = b"".join(gzip.compress(warc.record("response", i, u, b"body", "D", None, "x")) for i, u in enumerate(["u", url, "v"]))
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = [x for a in range(0, len(data), 300_000) for x in warc.RangeReader(pa.memory_map(str(tmp_path / "a.warc.gz")), len(data), a, a + 300_000)]
    assert [fields["WARC-Target-URI"] for fields, _ in got] == ["u", url, "v"]


def test_warc_archives_are_read_by_many_tasks(spark):
    pages = spark.createDataFrame([(i, "u" * (2 << 20) if i == 3 else f"u{i}", f"{i} " * 3000) for i in range(40)], "page_id long, url string, html string").repartition(2)
    records = warc.read_archives(warc.write_archives(pages, fresh_path(spark, "w")), 300)
    assert records.rdd.getNumPartitions() == 16 and records.count() == 40
    assert {len(r["url"]) for r in records.where("page_id = 3").collect()} == {2 << 20}


def test_warc_of_many_repeated_payloads(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "" if i % 3 else f"p{i % 6}") for i in range(60)] + [(70 + i, "u", f"q{i // 2}") for i in range(20)], "page_id long, url string, html string")
    names = ("page_id", "record_type", "refers_to", "payload_digest")
    read = lambda: sorted(tuple(str(r[n]) for n in names) for r in warc.read_archives(warc.write_archives(pages, fresh_path(spark, "w"))).collect())
    want = read()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("sparkloom.llm.common.HEAVY", 5)
    assert read() == want


def test_warc_least_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(pages, fresh_path(spark, "w"), least_bytes=3)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.read_archives(warc.write_archives(pages.limit(0), fresh_path(spark, "w"))).count() == 0


# --- main text ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div id=content><p>Hello <b>wor</b>ld &amp; all</p><div class="cookie-notice"><p>accept cookies please</p></div><ul><li>one<li>two</ul><div class=comments><p>a nice long comment of a reader that is longer than all the rest</p></div></div>', "Hello world & all\none\ntwo"),
        ("plain text only", "plain text only"),
        ("", ""),
        (None, ""),
        ("<p>un<closed", "un"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<article><header><h1>T</h1></header><p>x &lt;y&gt; &#233;&nbsp; z</p></article>", "T\nx <y> é z"),
        ('<body class="has-sidebar"><nav>menu</nav><header>Site</header><main><h1>A</h1><p>b<br>c</p><aside>side</aside><form><p>subscribe</p></form><script>var a="</p>";</script><style>p{}</style><!-- c --></main><footer>f</footer>', "A\nb c"),
        ('<div><p>text</p><p hidden>no</p><p style="display:none">no</p><div role="navigation">no</div><div aria-hidden="true">no</div></div>', "text"),
        ('<div class="post"><div class="adBox">buy</div><p>real words here</p><div class="sponsored-links">x</div></div><div class="readMore related-posts"><p>other words that are longer than those of the post itself by far</p></div>', "real words here"),
        ("<p>a < b and c > d", "a < b and c > d"),
        ("<article><p><b>Title<br><p>next</p></article><footer>f</footer>", "Title\nnext"),
    ],
)
def test_main_text(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><section><p>{'a' * 1000}</p></section><section><p>{'b' * 400}</p></section><section><p>{'c' * 300}</p></section></article>", "\n".join(("a" * 1000, "b" * 400, "c" * 300))),
        ("<body><article><h1>T</h1>" + "".join(f"<div class=row><div class=col><p>{c * 50}</p></div></div>" for c in "abc") + "</article><footer>f</footer></body>", "\n".join(("T", "a" * 50, "b" * 50, "c" * 50))),
        (f"<body><div class=post><h1>T</h1><p>lead</p><div class=entry><p>{'a' * 500}</p></div></div><nav>n</nav></body>", "T\nlead\n" + "a" * 500),
        (f"<body><div class=strip><p>hi</p></div><div class=story><p>{'a' * 500}</p></div></body>", "a" * 500),
        (f"<body><div class=other><p>{'b' * 60}</p></div><div><article><p>{'a' * 100}</p></article></div></body>", "a" * 100),
        ("<article><h2 id=how-to-search-and-share>H</h2><section id=social-history><p>x</p></section><div id=share-buttons>no</div><div id=comments>no</div></article>", "H\nx"),
        ('<article id="how-to-comment"><p>x</p></article><article id="comment-7"><p>no</p></article>', "x"),
    ],
)
def test_main_text_is_whole(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h2 id=related-work>R</h2><p>t</p></article>", "R\nt"),
        ("<article><section id=search>S</section><p>b</p></article>", "S\nb"),
        ("<article><p class=share-price>Shares rose.</p></article>", "Shares rose."),
        ("<article><p>a <math><mi>x</mi></math> b</p></article>", "a x b"),
        ("<article><td class=menu>m</td><p class=notice>n</p><p class=ad>buy</p><div class='comment-list'>c</div></article>", "m\nn"),
    ],
)
def test_article_text_is_not_judged_by_names(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize(
    "page, length",
    [("<a " * 350_000, 0), ("<div>" * 100_000 + "x", 1), ("<div><p>t" * 50_000, 99_999), ("<b>" * 100_000 + "<p>x</p>" * 50_000, 99_999), ('<a "' * 250_000 + ">", 0), ('<a x="' * 200_000 + ">y", 1), ("<!--" * 250_000, 0), ("<li>" * 100_000 + "x", 1), ("<i><div>" + "<b>" * 100_000 + "</i>" * 100_000 + "x", 1), ("<a" + " = " * 300_000 + ">x", 1)],
)
def test_hostile_pages_take_linear_time_and_memory(page, length):
    import time
    import tracemalloc

    start = time.thread_time()
    text = html.extract(page)
    assert len(text) == length and time.thread_time() - start < 5
    small = page[: len(page) // 4]
    tracemalloc.start()
    html.extract(small)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 4 * peak < 200e6


def test_all_containers_at_the_hosts_path(spark):
    one = lambda t: f"<body><div class=side><p>zz</p></div><div class=part><p>{t}</p></div></body>"
    more = f"<body><div class=side><p>{'z' * 90}</p></div><div class=part><p>{'a' * 200}</p></div><div class=part2><p>{'b' * 30}</p></div><div class=part><p>{'c' * 90}</p></div></body>"
    lead = f"<body><div class=side><p>{'z' * 90}</p></div><div class=post><h1>T</h1><div class=part><p>{'a' * 200}</p></div></div></body>"
    rows = [(i, "http://h/a", one(c * 300)) for i, c in enumerate("uvwxy")] + [(7, "http://h/a", more), (8, "http://h/b", lead)]
    got = {r["page_id"]: r["text"] for r in html.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "u" * 300 and got[7] == "\n".join(("a" * 200, "b" * 30, "c" * 90))
    nested = "<body><div class=side><p>zz</p></div><div class=post><div class=part><p>{}</p></div></div></body>"
    assert html.extract(lead, ">body>div.post>div.part") == "T\n" + "a" * 200 and html.extract(nested.format("a" * 200), ">body>div.post>div.part") == "a" * 200


def test_host_votes(spark, monkeypatch):
    article = lambda t: f"<div class='box7'><p>{'menu like words ' * 30}</p></div><article class='c1 story9'><p>{t}</p></article>"
    usual = lambda t: f"<div class='box8'><p>x</p></div><article class='story4 c2'><p>{t * 20}</p></article>"
    rows = [(i, "http://h.com/a", usual(f"word{i} ")) for i in range(5)] + [(9, "https://u@H.com:80/b", article("the real story " * 10)), (10, None, "<p>no host</p>"), (11, "x", None), (11, "x", None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    assert {(r["host"], r["path"]) for r in html.host_paths(pages).collect()} >= {("h.com", ">article.c.story")}
    got = {r["page_id"]: r["text"] for r in html.extract_main(pages).collect()}
    assert got[9] == " ".join("the real story".split() * 10) and got[10] == "no host" and got[11] == ""
    assert html.extract_main(pages).count() == len(rows) and html.extract_main(pages.limit(0)).count() == 0
    whole = sorted(str(tuple(r)) for r in html.extract_main(pages).collect())
    monkeypatch.setattr(html, "BROADCAST_ROWS", 0)
    for heavy in (2, 1000):
        monkeypatch.setattr("sparkloom.llm.common.HEAVY", heavy)
        assert sorted(str(tuple(r)) for r in html.extract_main(pages).collect()) == whole


def test_pages_of_the_tables(spark):
    import re
    from html import unescape

    def plain(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = re.split(r"</?(?:p|h1|h2|div|ul|li)\b[^>]*>", inner)
        lines = (" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br/?>", " ", x))).split()) for x in parts)
        return "\n".join(x for x in lines if x)

    sf = "/root/testdata/sf0.01"
    want = {r["page_id"]: plain(r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = html.op9_html_extraction(spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want and all(r["n_chars"] == len(r["text"]) for r in rows)


# --- chats ----------------------------------------------------------------------------------------------------------


def conversation(conv, said, start=0):
    return [(conv, start + k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(said)]


CHATS = (
    conversation(1, ["a", "b", "c"])
    + conversation(2, ["a", "b"])
    + conversation(3, ["a"])
    + conversation(4, ["a", "x"])
    + conversation(5, ["a", "b", "c"])
    + conversation(6, ["q"] * 600)
    + conversation(7, ["q"] * 599)
    + conversation(8, ["q"] * 256)
    + conversation(9, ["a"], start=1)
    + [(10, None, None, None), (10, 0, "user", "x<|im_end|>y"), (10, 0, "user", "x<|im_end|>y"), (10, 0, "tool", "t"), (None, 0, "user", "a"), (None, 1, "user", "zz")]
    + conversation(11, ["same"] * 3)
    + conversation(11, ["same"] * 3)
)


def test_chats_against_sql(spark):
    df = spark.createDataFrame([(*r, "p") for r in CHATS], "conv_id long, turn long, role string, text string, part string").repartition(5)
    got = sorted(tuple(r) for r in chat.format_chats(df).collect())
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(CHATS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM frame")
    assert got == sorted(con.sql(chat.ORACLE_SQL).fetchall())
    assert sorted({r[0] for r in got}) == [1, 4, 6, 9, 10, 11]
    copies = {r[0]: r[3] for r in got}
    assert copies[1] == 2 and copies[4] == 1
    assert [r[1] for r in got if r[0] == 6] == [0, 1, 2]
    text = "".join(r[5] for r in got if r[0] == 10)
    assert text.count(chat.CLOSE) == 3 and "x< |im_end|>y" in text and text.startswith(f"{chat.OPEN}\n{chat.CLOSE}")


def test_chats_with_ties_are_collapsed(spark):
    said = [(1, 1, "user", "a"), (2, 1, "user", "a"), (2, 1, "user", "b"), (3, None, "user", "p"), (4, None, "user", "p"), (4, None, "user", "q"), (5, None, "user", "q"), (6, 1, "a", "z"), (6, 1, "b", "a"), (7, 1, "a", "z"), (8, 1, "b", "a")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted(tuple(r) for r in chat.format_chats(df).collect())
    assert [r[0] for r in got] == [2, 4, 5, 6, 8]
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(said, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT * FROM frame")
    assert got == sorted(con.sql(chat.ORACLE_SQL).fetchall())


def test_chats_are_native(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.format_chats(df.limit(0)).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = [], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if k < 4 else {}
        if name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            known = [(i in after, labels[i]) for i in before if i in labels]
            assert sum(a == bool(b) for a, b in known) / len(known) > 0.95
        elif name == "ngram_jaccard_join":
            want = jaccard.brute_force(sorted(before.items()))
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            for i, t in before.items():
                if i not in after:
                    assert decontaminate.brute_force(t, items)[1] > 0
            some = sorted(after)[:10]
            assert all(decontaminate.brute_force(after[i], items)[1] == 0 for i in some)
        elif name == "pii":
            assert set(after) == set(before)
            for i, t in after.items():
                assert pii.brute_force(t)[:4] == (0, 0, 0, 0)
                assert t == before[i] or pii.brute_force(before[i])[5]
        elif name == "best_fit_packing":
            total = docs.groupBy("sequence_id").sum("length").collect()
            assert all(r[1] <= packing.CAPACITY for r in total) and len(total) <= -(-sum(r[1] for r in total) // packing.CAPACITY) + 1
    assert kept[0] >= kept[1] >= kept[2] == kept[3] <= kept[4]


def test_pipeline_takes_awkward_documents(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "one two three four five six", None, None, 27), (3, "one two three four five six", None, None, 27), (None, "no id at all", "en", "s", 12), (4, "mail a@b.co now please and thank you", "en", "s", 36)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "4", "None"]


def test_entry_lists_every_operator():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    assert free_name(["A", "_b", "b"], "B") == "__B" and json.dumps(names)
