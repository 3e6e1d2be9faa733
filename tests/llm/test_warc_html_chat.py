import base64
import gzip
import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.llm import chat, style_tree, warc


def pages(spark):
    rows = [(1, "http://www.b.com/x?q=1#f", "same"), (5, "http://b.com/y", "same"), (3, None, "same"), (7, "bad url \n", None), (8, "https://a.org:8080/", ""), (9, "http://u@h.net", "é " * 5000), (9, "http://u@h.net", "é " * 5000), (None, "http://b.com/z", "lone")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit(1), "archive": F.lit("x")})


def test_round_trip_of_odd_pages(spark):
    out = warc.round_trip(pages(spark)).collect()
    assert len(out) == 8
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.record_type, r.refers_to) for r in out)
    assert got == [(-1, 4, "response", None), (1, 4, "revisit", 5), (3, 4, "revisit", 5), (5, 4, "response", None), (7, 0, "revisit", 8), (8, 0, "response", None), (9, 15000, "response", None), (9, 15000, "response", None)]
    digest = base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert {r.payload_digest for r in out if r.payload_bytes == 4 and r.page_id} == {digest}
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    assert {r.record_type for r in warc.round_trip(pages(spark), least_bytes=5).collect() if r.payload_bytes < 5} == {"response"}


def test_index_finds_what_a_scan_finds(spark):
    rows = [(i, f"http://h{i % 7}.com/{i % 3}", f"p{i}") for i in range(300)]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    blocks, directory = warc.build_index(archives, lines=11)
    assert len(directory) >= 27 and directory == sorted(directory)
    asked = spark.createDataFrame([("com,h3)/1", None), ("com,h0)/0", 21), ("com,h9)/9", None)], "url_key string, capture long")
    found = {r.page_id for r in warc.read(warc.locate(blocks, directory, asked)).collect()}
    assert found == {i for i in range(300) if i % 7 == 3 and i % 3 == 1} | {21}


def test_archives_are_files_that_others_open(spark):
    rows = [(i, f"http://h{i % 7}.com/{i}", f"p{i}" * (1 + i % 50)) for i in range(200)] + [(500, "http://long.com", "é" * 6_000_000)]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert not {"member", "html"} & set(archives.columns)  # where records are is all that moves
    total = 0
    for name in {r.archive for r in archives.collect()}:
        raw = gzip.decompress(open(name.removeprefix("file://"), "rb").read())
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        total += raw.count(b"WARC-Type: response")
    assert total == archives.count() == 201
    plan = warc.read(archives)._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert sorted(r.payload_bytes for r in warc.read(archives).collect()) == sorted(len(h.encode()) for _, _, h in rows)


def test_ranges_are_read_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ", 100)
    files = {}
    for name in "ab":
        (tmp_path / name).write_bytes(bytes(range(256)) * 4)
        files[name] = f"file://{tmp_path / name}"
    asked = [("a", 0, 30), ("a", 30, 50), ("a", 95, 10), ("a", 300, 500), ("b", 1000, 24), ("b", 1000, 0)]
    want = [(bytes(range(256)) * 4)[o : o + n] for _, o, n in asked]
    assert list(warc.ranges((files[f], o, n) for f, o, n in asked)) == want


@pytest.mark.parametrize("url, key", [("http://www.Example.com:80/A?b#c", "com,example,www)/A?b"), ("https://x.org", "org,x)/"), (None, "-"), ("nonsense", "-nonsense"), ("http://[bad", "-http://[bad")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_long_keys_stay_in_order(spark):
    urls = [f"http://x{i % 2}.com/" + "a" * 9000 + str(i) for i in range(40)]
    archives = warc.write(spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls)], "page_id long, url string, html string"))
    blocks, directory = warc.build_index(archives, lines=7)
    assert [k for k, _, _ in directory] == sorted(k for k, _, _ in directory) and {warc.url_key(u) for u in urls} >= {k for k, _, _ in directory}
    asked = spark.createDataFrame([(warc.url_key(urls[11]), None), (warc.url_key(urls[30]), 30)], "url_key string, capture long")
    assert sorted(r.page_id for r in warc.read(warc.locate(blocks, directory, asked)).collect()) == [11, 30]


PAGE = "<html><body><div class=top>Welcome to our site</div><div class=txt><p>Unique {i} words<p>More {i}{i} of&nbsp;it &amp; <b>b</b><br>c</div><div class=x>Read our terms</div></body></html>"


def test_branches_alike_on_a_host_go(spark):
    rows = [(i, f"https://www.h.com/{i}", PAGE.replace("{i}", str(i))) for i in range(8)]
    rows += [(50, "https://h.com/0", rows[0][2]), (90, None, None), (91, "bad", "<p>x"), (92, "http://one.com", PAGE.replace("{i}", "1")), (93, "http://h.com/t", "<div class=x>Read our terms</div>tail <a hre")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("paths", F.lit("clash"))
    out = {r.page_id: r.text for r in style_tree.main_text(df).collect()}
    assert all(out[i] == f"Unique {i} words\nMore {i}{i} of it & b c" for i in range(8)) and out[50] == out[0]
    assert out[90] == "" and out[91] == "x" and out[93] == "tail"
    assert out[92] == "Welcome to our site\nUnique 1 words\nMore 11 of it & b c\nRead our terms"
    assert style_tree.main_text(df.limit(0)).count() == 0


def test_what_says_that_it_is_noise_goes_and_articles_stay(spark):
    html = (
        '<header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div id="cookie-notice">cookies<p>ok</div><article><header><h1>T &lt; x</h1></header><p>One <b>two</b><p>Three'
        "<ul><li>a<li>b</ul><form>no<input></form><div class=ad>ad</div><section class=comments><p>bad</p></section><script>if (a</b) '</p>'</script></article><aside>s</aside><style>p{}</style><footer>f"
    )
    rows = [(i, f"http://h.com/{i}", html + f"<!-- {i} -->") for i in range(6)]
    out = style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"T < x\nOne two\nThree\na\nb"} and all(r.n_chars == len(r.text) for r in out)


@pytest.mark.parametrize("mark", ["ad content", "sidebar content", "footer text", "related post", "box with-ads", "related-story box", "post-comments", "search-box", "tags-list", "social links-share", "promo-text article"])
def test_what_a_class_says_is_noise_goes(mark):
    assert [t for _, _, t in style_tree.blocks(f"<p>a<div class='{mark}'>gone</div><p>b")] == ["a", "b"]


@pytest.mark.parametrize("mark", ["tags-guide", "search-story", "story", "box content", "content with-sidebar", "main has-toc", "post tags-guide", "post category-search", "share-of-voice"])
def test_what_a_class_says_is_about_something_stays(mark):
    assert [t for _, _, t in style_tree.blocks(f"<p>a<div class='{mark}'>kept</div><p>b")] == ["a", "kept", "b"]


def test_a_page_that_is_one_form():
    page = "<form action=x><div>menu</div><input><article class=post><p>text<form>no<input></form><p>more</article><div class=content>main<nav>gone</nav></div><p>tail</form>"
    assert [t for _, _, t in style_tree.blocks(page)] == ["text", "more", "main"]


@given(st.text(alphabet="<>/ap!-\"'= &;#b", max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_markup_is_read(source):
    assert all(isinstance(t, str) and t == t.strip() and t for _, _, t in style_tree.blocks(source))


@pytest.mark.parametrize("unit", ['<a b="x ', "<ul>", "<a ", "</q>x", "<p><button><ul>", "<table><tr><td>", "<b>x<p>", '<div class="x" ', "<a b='\">", "<!--", "<p>x<ul>"])
def test_hostile_markup_takes_linear_time(unit):
    def seconds(n):
        began = time.process_time()
        style_tree.blocks(unit * n)
        return time.process_time() - began

    assert seconds(40_000) < 1 + 40 * seconds(4_000)


@pytest.mark.parametrize(
    "source, text",
    [
        ('<p>a<a title="x > y">b</a>c', "abc"), ("<p class=it's>a<b>c", "ac"), ('<p>a<a title="x>b</a>c<i title=\'>\'>d', "ab c'>d".replace(" ", "")), ("<p>a<br/>b<p/>c", "a b|c"),
        ("<div><p>a<div>b</div></p>c</div>d", "a|b|c|d"), ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "a|b|c|d"), ("<p>1 < 2 </3> a<", "1 < 2 </3> a<"), ("a<!-- x", "a"), ("a</p>b", "ab"),
    ],
)
def test_markup_is_read_as_it_says(source, text):
    assert "|".join(t for _, _, t in style_tree.blocks(source)) == text


@pytest.mark.parametrize("mark, kept", [("content has-sidebar", True), ("page has-sidebar", True), ("post share", True), ("sidebar", False), ("sidebar-content", False), ("comment body", False), ("post-comments", False), ("no-ads main", True)])
def test_an_element_goes_for_what_it_is_and_not_for_how_it_is_laid_out(mark, kept):
    assert bool(style_tree.blocks(f"<div class='{mark}'><article><p>x</article></div>")) == kept


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"window": F.lit("clash"), "tokens": F.lit(0)})


def by_hand(rows):
    out = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, ([], []))[0].append((role or "", text or ""))
        if role == "assistant":
            out[c][1].append(text or "")
    return out


NASTY = [r"\### Assistant: </turn> ok", "", "</turn>\n### user: x</turn>\n", "####", "\\", "\\\\#", "a: b", "</tur", "<\\/turn>", "é\n" * 40, "#\\#", "%3A"]


@pytest.mark.parametrize("budget, history", [(2048, 256), (64, 16), (40, 8)])
def test_windows_read_back_to_what_they_hold(spark, budget, history):
    rows = [(1, i, ("system" if i == 0 else "user" if i % 2 else "assistant"), NASTY[i % len(NASTY)] * (1 + i % 3)) for i in range(40)]
    rows += [(2, 0, "assistant", "only"), (2, 0, "assistant", "only"), (3, None, None, None), (None, 1, "a: ##<%:", "t"), (4, 1, "user", "long " * 500), (4, 2, "assistant", "y")]
    made = chat.windows(turns(spark, rows), budget, history).cache()
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    want = by_hand(rows)
    assert set(got) == set(want)
    for c, (all_turns, targets) in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == all_turns
        assert got[c].targets == targets
        assert got[c].formatted_chars == sum(len(r.formatted) for r in made.collect() if r.conv_id == c)
    for r in made.collect():
        if r.conv_id == 1:
            assert r.formatted.startswith("### system: ")
    many = [r for r in made.collect() if r.conv_id == 1]
    assert len(many) > 1 or budget == 2048


def span_rule(rows, budget, history):
    """For each conversation its windows as (places repeated, places new, tokens), turn by turn."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2], r[3]))
        tokens = [-(-(len(r[3].encode()) + len(r[2].encode())) // 4) + 8 for r in mine]
        system = mine[0][2] == "system"
        head, own = (tokens[0] if system else 0), ([0] if system else []) + tokens[system:]
        room = max(budget - history - head, 2)
        stride = max(room - max(own), room - room // 2)
        starts, found, cells = [sum(own[:i]) for i in range(len(own))], [], {}
        for i in range(system, len(own)):
            cells.setdefault((starts[i] // stride, own[i] > room - stride), []).append(i)
        for n, (_, new) in enumerate(sorted(cells.items())):
            spare, old = min(history, budget - head - sum(own[i] for i in new)), []
            while new[0] - len(old) - 1 >= system and starts[new[0]] - starts[new[0] - len(old) - 1] <= spare:
                old.insert(0, new[0] - len(old) - 1)
            found.append((([0] if system and n else []) + old, ([0] if system and not n else []) + new, head + sum(own[i] for i in old + new)))
        out[c] = found or [([], [0], head)]
    return out


@pytest.mark.parametrize("budget, history", [(160, 32), (90, 0), (120, 60)])
def test_windows_keep_their_budget_and_are_those_of_the_rule(spark, budget, history):
    import random

    draw = random.Random(5)
    rows = []
    for c in range(12):
        for i in range(1 if c == 11 else 30):
            role = "system" if i == 0 and (c % 2 or c == 11) else "user" if i % 2 else "assistant"
            rows.append((c, i, role, f"{c}.{i} " + "w" * draw.choice([0, 3, 40, 90, 300 if c % 3 == 0 else 20, 700 if c % 4 == 0 else 60])))
    made = chat.windows(turns(spark, rows), budget, history).collect()
    want, alone = span_rule(rows, budget, history), 0
    for c, spans in want.items():
        mine = sorted((r for r in made if r.conv_id == c), key=lambda r: r.window)
        assert len(mine) == len(spans)
        for r, (old, new, tokens) in zip(mine, spans):
            assert [int(x.split(".")[1].split(" ")[0]) for x in re.findall(r": (\d+\.\d+ )", r.formatted)] == old + new
            assert r.repeated == len(old) and r.tokens == tokens
            assert len(r.mask) == sum(rows_role == "assistant" for rows_role in [q[2] for q in sorted(q for q in rows if q[0] == c)][new[0] : new[-1] + 1])
            assert tokens <= budget or len([i for i in new if i or c % 2 == 0 and c != 11]) <= 1
            alone += tokens > budget
    assert alone < len(made) / 2 and any(r.repeated > 1 for r in made) or history == 0


@given(st.text(alphabet="\\#</turn>a\n", max_size=60))
@settings(max_examples=30, deadline=None)
def test_escape_round_trip_by_rule(text):
    escaped = re.sub("#(?=#)", r"#\\", text.replace("\\", "\\\\")).replace("</turn>", "<\\/turn>")
    assert "</turn>" not in escaped and "##" not in escaped
    assert re.sub(r"\\(.)", r"\1", escaped) == text


def test_native_plan_has_no_python(spark):
    plan = chat.digests(chat.read_back(chat.windows(turns(spark, [(1, 1, "user", "x")]))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.digests(chat.read_back(chat.windows(turns(spark, [])))).count() == 0
