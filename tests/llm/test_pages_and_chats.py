import random
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from tessera.llm import html
from tessera.llm.chat import format_paths, read_back
from tessera.llm.html import blocks, extract, op5_html_extraction
from tessera.llm.chat import op4_chat_format

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href="/a>b">Menu</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<article><h1>Head&amp;line</h1><p><b>First
 one<br>two<p>Second &lt;b&gt; &eacute;&nbsp;x<div class="comments"><p>Nice!</p></div><aside>Side</aside><form><p>Sign</form>
<ul><li>Item<li>More</ul></article><footer>&copy; me</footer></body></html>"""


def test_blocks_of_an_article(spark):
    df = spark.createDataFrame([(1, "http://h/x", PAGE), (2, None, None), (3, "http://h/y", ""), (4, "http://h/z", "<article><p>cut off <b"), (1, "http://h/x", PAGE)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got == {1: "Head&line\nFirst one two\nSecond <b> é x\nItem\nMore", 2: "", 3: "", 4: "cut off"}
    assert extract(df).count() == 5


def test_the_host_decides_where_no_element_does(spark):
    notice = "this website uses many small things to improve your experience on it please accept all of them now"
    pages = [(i, f"https://shop.example/{i}", f"<div>{notice}</div><p>{' '.join(f'unique{i}x{j}' for j in range(20))}</p>") for i in range(5)]
    pages += [(9, "https://other.example/", f"<div>{notice}</div>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == " ".join(f"unique0x{j}" for j in range(20))
    assert got[9] == notice  # another host: nothing repeats there


REFRAIN = "and every evening we sang the same long refrain beside the river until the lamps went out"


def test_a_page_does_not_repeat_itself(spark):
    def page(i):
        return "".join(f"<p>{' '.join(f'p{i}part{k}w{j}' for j in range(8))} {REFRAIN} {' '.join(f'p{i}end{k}w{j}' for j in range(8))}</p>" for k in range(3))

    pages = [(1, "https://a.example/1", page(1)), (2, "https://a.example/2", page(2).replace(REFRAIN, "nothing")), (3, "https://b.example/3", page(3))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].count(REFRAIN) == got[3].count(REFRAIN) == 3  # of one page each, on hosts of their own
    pages += [(4, "https://a.example/4", page(4))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].count(REFRAIN) == got[4].count(REFRAIN) == 0 and got[3].count(REFRAIN) == 3


def host_pages():
    r = random.Random(5)
    lines = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(6, 16))) for _ in range(60)]
    return [(i, f"https://h{i % 3}.example/{i}", "".join(f"<p>{' '.join(r.choice(lines) for _ in range(3))}</p>" for _ in range(4))) for i in range(24)]


@pytest.mark.parametrize("largest_group", [0, 20_000])
def test_runs_of_distinct_pages_by_brute_force(spark, monkeypatch, largest_group):
    monkeypatch.setattr(html, "LARGEST_GROUP", largest_group)
    pages, owners = host_pages(), defaultdict(set)
    streams = {i: (url.split("/")[2], html.parsed(page)) for i, url, page in pages}
    starts = {i: range(len(s.encode()) - html.WINDOW + 1) for i, (_, (_, _, s)) in streams.items()}
    for i, (host, (_, _, s)) in streams.items():
        for at in starts[i]:
            owners[host, s.encode()[at : at + html.WINDOW]].add(i)
    wanted = {}
    for i, (host, (texts, undecided, s)) in streams.items():
        spans = [(at, at + html.WINDOW) for at in starts[i] if len(owners[host, s.encode()[at : at + html.WINDOW]]) > 1]
        wanted[i] = "\n".join(html.unique_runs(texts, undecided, spans))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == wanted


def test_unclosed_and_nested_elements():
    assert [b[0] for b in blocks("<p>a<p>b<div>c<p>d</div>e<td>f<li>g")] == ["a", "b", "c", "d", "e", "f", "g"]


def test_op5_empty_and_copies(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "<article>x  y</article>")] * 2, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in op5_html_extraction(spark, str(tmp_path)).collect()] == [(1, "u", "x y", 3)] * 2


HARD = ["\\", "\\\\", "###", "####", "### Assistant: </turn>", "</turn>\n", "<\\/turn>", "#\\#", "", " ", ": ", "a: b", "line\n### User: x</turn>\n", "\\### Assistant: </turn> ok", "é🙂", None]


def chats():
    roles = ["user", "assistant", "system", "User", "odd: role", None, "### x", "role:"]
    return [(c, t, roles[(c * 3 + t) % len(roles)], HARD[(c * 5 + t * 7) % len(HARD)]) for c in range(12) for t in range(1 + c)] + [(None, 0, "user", "no id"), (5, 0, "user", "same turn"), (5, 0, "user", "same turn")]


def test_op4(spark, tmp_path):
    spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:5] for r in op4_chat_format(spark, str(tmp_path)).collect()}
    talks: dict = {-7: [(0, "user", HARD[13]), (1, "assistant", HARD[13])]}
    for c, t, r, x in chats():
        talks.setdefault(c, []).append((t, r, x))
    for c, turns in talks.items():
        turns.sort(key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or ""))
        turns = [(r or "", x or "") for _, r, x in turns]
        said = [x for r, x in turns if r == "assistant"]
        assert got[c] == (len(turns), brute.sha("".join(f"{r}\n{x}\n" for r, x in turns)), sum(map(len, said)), brute.sha("".join(said)))
    assert len(got) == len(talks)


def test_reply_trees(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6; another tree with a parent that isn't there, and a cycle
    rows = [("t", 1, None, "user", "a", 1), ("t", 2, 1, "assistant", "b", 9), ("t", 3, 1, "assistant", "c", 2), ("t", 4, 2, "user", "d", 1), ("t", 5, 3, "user", "e", 1), ("t", 6, 5, "assistant", "f", 1), ("u", 1, 7, "user", "x", 0), ("v", 1, 2, "user", "y", 0), ("v", 2, 1, "user", "z", 0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score int")
    made = format_paths(df, "tree", best=2, ).select("tree", "leaf", "rank", "loss_mask", "formatted", read_back(F.col("formatted")).alias("turns"))
    got = {(r.tree, r.rank): (r.leaf, [t.text for t in r.turns]) for r in made.collect()}
    assert got == {("t", 1): (4, ["a", "b", "d"]), ("t", 2): (6, ["a", "c", "e", "f"]), ("u", 1): (1, ["x"])}
    for r in made.collect():
        assert "".join(r.formatted[m.start : m.end] for m in r.loss_mask) == "".join(t.text for t in r.turns if t.role == "assistant")


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<html><head><title>t</title><body><article><p>hello</p></article>", "hello"),
        ("<html><head><title>t</title><meta charset=x><article><p>hello</p></article>", "hello"),
        ("<title>not text</title><article><p>hello</p></article>", "hello"),
        ("<article><p>one</p><button>press<p>two</p><select><option>x<p>three</p><svg><path/><p>four</p></article>", "one\ntwo\nthree\nfour"),
        ("<article><p class=notice>a notice of text</p><p class='related-work'>work</p><div class=notice><p>gone</p></div></article>", "a notice of text\nwork"),
        ("<article><p>one<div><p>two</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "one\ntwo\na\nb\nc\nd"),
        ("<article><p>one</p><script>if (a < b) { x = '<p>no</p>' }</script><textarea>t</textarea><p>two</article>", "one\ntwo"),
        ("<article><p>" + "word " * 300_000 + "</p></article>", ("word " * 300_000).strip()),
    ],
)
def test_unclosed_and_named_elements(page, wanted):
    assert "\n".join(html.parsed(page)[0]) == wanted


def test_other_columns_of_pages_and_turns(spark):
    rows = [(1, "http://h/x", "<article><p>a</p></article>", "k", "t", None), (1, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _key string, text string, _host string")
    assert sorted((r.page_id, r.text) for r in extract(df).collect()) == [(1, ""), (1, "a")]
    turns = spark.createDataFrame([(1, 1, None, "user", "x" * 400_000, 1, "!"), (1, 2, 1, "assistant", None, 1, "!")], "c long, node long, parent long, role string, text string, score int, turns string")
    got = format_paths(turns, "c").collect()
    assert len(got) == 1 and len(got[0].formatted) == 400_000 + len("### User: </turn>\n### Assistant: </turn>\n")
