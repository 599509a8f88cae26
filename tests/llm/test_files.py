"""BPE and plane files against the tokenizers library, template removal by hand, the pipeline by its parts."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cadenza.llm import bpe, html, planes, simhash, toxicity
from tests.llm.conftest import MESSY

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=1500, seed=1):
    rng = random.Random(seed)
    pool = [chr(c) for c in [*range(0x300), *range(0x1680, 0x1682), *range(0x2000, 0x2070), 0x3000, 0xFEFF, *range(0x4E00, 0x4E10), *range(0x1F600, 0x1F610), 0x1100, 0x1161]]
    pool += [" "] * 200 + ["\n"] * 40 + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "123", "The", "the."] * 15
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_merges_equal_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.Vocabulary(BYTES)
    for text in [*odd_texts(), "a" * 3000 + "é" * 2000, "x" * 64, "x" * 65, "lo" * 500]:
        ids = [i for w in own.encode(text) for i in w[0]]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_letters_of_newer_unicode_are_cut_as_the_library_cuts_them():
    library, own = Tokenizer.from_file(BYTES), bpe.Vocabulary(BYTES)
    rng = random.Random(5)
    newer = [c for c in bpe.newer_characters() if c != "-"]
    newer = [*newer[:200], *"\u1c89\u1c8a\U00016139\U000105c0"]
    assert len(newer) > 50
    for _ in range(500):
        text = "".join(rng.choice([*newer, *"aZ1 .\n"]) for _ in range(12))
        assert [i for w in own.encode(text) for i in w[0]] == library.encode(text, add_special_tokens=False).ids


def test_scan_and_heap_merge_alike():
    own = bpe.Vocabulary(BYTES)
    for text in odd_texts(300, 7):
        word = text.encode()
        assert own._scan(word) == own._heap(word)


def test_encoded_rows_and_round_trip(spark, documents):
    df = documents(MESSY, clashes=True)
    found = bpe.encoded(df, BYTES)
    texts = {r["doc_id"]: r["text"] for r in bpe.decoded(found, BYTES).collect()}
    assert texts == {r[0]: r[1] or "" for r in MESSY}
    library = Tokenizer.from_file(BYTES)
    assert {r["doc_id"]: list(r["ids"]) for r in found.collect()} == {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in MESSY}
    assert bpe.encoded(documents([]), BYTES, ids=False).count() == 0


@pytest.mark.parametrize(("bits", "planes_"), [(8, 4), (1, 32), (1, 16), (8, 2)])
@pytest.mark.parametrize("n", [1, 7, 1000])
def test_planes_round_trip(bits, planes_, n):
    ids = np.random.default_rng(n).integers(0, 49408, n).astype("<u4")
    assert (planes.from_planes(planes.to_planes(ids, bits, planes_), n, bits) == ids).all()


def test_pieces_are_encoded_as_whole_texts():
    library, own = Tokenizer.from_file(WORDS), planes.TextEncoder(WORDS)
    some = odd_texts(1500, 3)
    for text, ids in zip(some, own.encode(some), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("bits", "limits"), [(8, {}), (1, {"file_ids": 20}), (8, {"file_docs": 2})])
def test_files_hold_all_documents_in_order(spark, documents, tmp_path, bits, limits):
    rows = [*MESSY, (None, "no id", "en", "a"), (4, "again", "en", "a")]
    folder = f"file://{tmp_path}/planes"
    found = planes.token_files(documents(rows, clashes=True).repartition(5), WORDS, folder=folder, files=3, bits=bits, **limits).collect()
    library, start, wanted = Tokenizer.from_file(WORDS), 0, []
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        wanted.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == wanted
    assert not [p for p in (tmp_path / "planes").iterdir() if p.name.startswith(".draft") and not p.name.endswith(".crc")]
    written = len(list((tmp_path / "planes").glob("part-*.planes")))
    assert written > 3 if limits else written <= 3


def test_a_block_is_read_by_itself(tmp_path):
    from pyarrow import fs

    store, ids = fs.LocalFileSystem(), np.arange(3 * planes.BLOCK + 5, dtype="<u4")
    with store.open_output_stream(str(tmp_path / "x")) as out:
        writer = planes.PlaneWriter(out)
        writer.add(1, ids[:10])
        writer.add(2, ids[10:])
        writer.close()
    with store.open_input_file(str(tmp_path / "x")) as source:
        reader = planes.PlaneReader(source)
        assert (reader.block(2) == ids[2 * planes.BLOCK : 3 * planes.BLOCK]).all() and len(reader.index) == 4
        assert reader.names == [1, 2] and reader.lengths.tolist() == [10, len(ids) - 10]
    (tmp_path / "torn").write_bytes((tmp_path / "x").read_bytes()[:-5])
    with store.open_input_file(str(tmp_path / "torn")) as source, pytest.raises(ValueError):
        planes.PlaneReader(source)


def test_no_documents_no_files(spark, documents, tmp_path):
    assert planes.token_files(documents([]), WORDS, folder=f"file://{tmp_path}/none").count() == 0


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice">We use</div>
<div class="content"><article><header><h1>Title &amp; more</h1></header><p>First <b>bo</b>ld&nbsp;text<br>next<p>Second&#33; <!-- no --><ul><li>one<li>two</ul>
<div class="ad-slot">Buy</div><form>Sign up<input></form><aside>side</aside><blockquote>Said</blockquote><table><tr><td>1<td>2</table>
<section id="comments"><p>Reader</p></section></article></div><div id="sidebar">side</div><footer>&copy; x</footer>"""


def test_article_without_what_is_left_out():
    assert html.Page(ARTICLE).text() == "Title & more First bold text next Second! one two Said 1 2"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &lt;text&gt; &am &amp x", "plain <text> &am & x"),
        ("<p>a<div>b</p>c</div>d", "a b c d"),
        ("<b>a<i>b</b>c", "abc"),
        ("<main><p>in</p></main><p>out</p>", "in"),
        ("<article>a</article><p>x</p><article>b</article>", "a b"),
        ("<p>unclosed <a href='x>y</p>", "unclosed y"),
        ("<article><p>kept</p><script>if (a < b) {}", "kept"),
        ("<div hidden>x</div><div role=navigation>y</div><p style='display: none'>z</p>w", "w"),
        ("a < b and 3 > 2", "a < b and 3 > 2"),
        ("<div class=topnav>m</div><div id=userComments>c</div><div class='cookiebar big'>k</div><div class=navy>kept</div>", "kept"),
        ("<article><div class='ad'>x</div><nav>t</nav><p>a</p><footer>f</footer></article>", "a"),
        ("<article><p class='social-study'>a</p><p class='alert-level'>b</p><div class='share-price-table'>c</div><section class='related-work'>d</section><p id='reply'>e</p></article>", "a b c d e"),
        ("<article><div class='share-buttons'>x</div><div class='big comment-list'>y</div><div id='relatedLinks'>z</div><p>a</p></article><p class='social-study'>s</p>", "a"),
    ],
)
def test_pages(page, text):
    assert html.Page(page).text() == text


def test_template_goes_by_host_and_prose_of_articles_stays(spark):
    def page(i, own):
        return f"<body><div><span>Welcome to the site</span></div><p>Story {own}</p><div><em>All about us</em></div></body>"

    rows = [(i, f"http://a.example/{i}", page(i, i), "x") for i in range(8)] + [(100 + i, f"http://b.example:80/{i}", page(i, i), "x") for i in range(2)]
    rows += [(200 + i, f"https://u@C.example/{i}", f"<article><p>shared passage</p><div class=box>Follow us</div><p>own {i}</p></article>", "x") for i in range(9)]
    rows += [(300 + i, "http://d.example/", "<div>copy</div><p>of one page</p>", "x") for i in range(9)]
    rows += [(400, None, None, "x"), (401, "no url", "", "x"), (None, None, "<p>t</p>", "x"), (402, "http://long.example", "<p>" + "long " * 50000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row string")
    for held in (html.HELD_HASHES, 0):
        found = {r["page_id"]: r for r in html.main_text(df, held_hashes=held).collect()}
        assert [found[i]["text"] for i in range(8)] == [f"Story {i}" for i in range(8)]
        assert found[100]["text"] == "Welcome to the site Story 0 All about us"
        assert [found[200 + i]["text"] for i in range(9)] == [f"shared passage own {i}" for i in range(9)]
        assert found[300]["text"] == "copy of one page"
        assert found[400]["text"] == found[401]["text"] == "" and found[400]["n_chars"] == 0 and found[None]["text"] == "t"
        assert found[402]["n_chars"] == 50000 * 5 - 1
    assert html.main_text(df.limit(0)).count() == 0


def test_near_copies_and_rare_passages_of_pages_without_articles_stay(spark):
    rng = np.random.default_rng(4)
    words = lambda k: " ".join(rng.choice([f"w{j}" for j in range(2000)], k))
    div = lambda t: f"<div>{t}</div>"
    site, passage, parts = div("Welcome to the site"), words(30), [words(60) for _ in range(4)]
    near = [[*parts[:2], parts[2].replace(" ", f" new{i} ", 1), parts[3]] for i in range(6)]
    own = [words(50) for _ in range(60)]
    rows = [(i, "http://a.example", site + "".join(map(div, x))) for i, x in enumerate(near)]
    rows += [(100 + i, "http://a.example", site + div(x) + (div(passage) if i < 8 else "")) for i, x in enumerate(own)]
    rows += [(200 + i, "http://b.example", "".join(f"<p>{x}</p>" for x in t)) for i, t in enumerate(near)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for held in (html.HELD_HASHES, 0):
        found = {r["page_id"]: r["text"] for r in html.main_text(df, held_hashes=held).collect()}
        assert [found[i] for i in range(6)] == [" ".join(t) for t in near] == [found[200 + i] for i in range(6)]
        assert [found[100 + i] for i in range(60)] == [f"{x} {passage}" if i < 8 else x for i, x in enumerate(own)]


def test_a_line_under_every_article_goes_and_a_passage_of_some_stays(spark):
    rng = np.random.default_rng(13)
    own = [" ".join(rng.choice([f"w{j}" for j in range(3000)], 40)) for _ in range(49)]
    rows = [(i, "http://a.example", f"<article><p>{own[i]}</p>" + ("<p>a passage of some</p>" if i < 14 else "") + "<p>Follow us everywhere</p></article>") for i in range(30)]
    rows += [(i, "http://b.example", f"<article><p>{own[i]}</p><p>Follow us everywhere</p></article>") for i in range(30, 49)]  # too few pages to tell
    found = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: own[i] + (" a passage of some" if i < 14 else " Follow us everywhere" if i >= 30 else "") for i in range(49)}


def test_templates_equal_a_plain_count(spark):
    """Sites without speaking names: what goes is what a plain count of equal block texts by host finds, as all pages differ much."""
    rng = np.random.default_rng(12)
    words = lambda k: " ".join(rng.choice([f"w{j}" for j in range(3000)], k))
    rows, blocks = [], {}
    for site, n in enumerate((4, 5, 19, 40)):
        shared = [(words(6), share) for share in (1.0, 0.6, 0.3, 0.2, 0.1)]
        for i in range(n):
            own = [words(40)] + [t for t, share in shared if rng.random() < share]
            own = [own[k] for k in rng.permutation(len(own))]
            blocks[len(rows)] = (site, own)
            rows.append((len(rows), f"http://s{site}.example/{i}", "".join(f"<section>{t}</section>" for t in own)))
    pages = {site: sum(s == site for s, _ in blocks.values()) for site, _ in blocks.values()}
    count = {}
    for site, own in blocks.values():
        for t in set(own):
            count[site, t] = count.get((site, t), 0) + 1
    template = {(s, t) for (s, t), n in count.items() if n >= html.MIN_PAGES and n >= html.MIN_SHARE * pages[s]}
    found = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r["text"] for i, r in found.items()} == {i: " ".join(t for t in own if (s, t) not in template) for i, (s, own) in blocks.items()}
    assert sum(r["n_deleted"] for r in found.values()) == sum((s, t) in template for s, own in blocks.values() for t in own) > 50


def test_counts_alone_find_what_stands_beside_articles(spark):
    """With the names left out of it, menus, adverts and footers on a few pages of many go; an article's own stays."""
    menus = [f"<nav><a>menu {k} of the site</a></nav>" for k in range(12)]
    ads = [f"<div>buy thing {k}</div>" for k in range(12)]
    rows = [(i, "http://a.example", f"<body>{menus[i % 12]}{ads[i % 10]}<article><p>own {i} text</p><p>shared by all</p></article><footer>site {i % 12}</footer></body>") for i in range(120)]
    rows += [(500 + i, "http://a.example", f"{menus[i]}{ads[0]}<p>page {i} without one</p><footer>site {i}</footer>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for held in (html.HELD_HASHES, 0):
        found = {r["page_id"]: r for r in html.main_text(df, named=False, held_hashes=held).collect()}
        assert all(found[i]["n_deleted"] >= 3 for i in range(120))
        assert [found[500 + i]["text"] for i in range(3)] == [f"page {i} without one" for i in range(3)]
        assert all(found[i]["text"] == f"own {i} text" for i in range(120))  # a line under every article is template


def test_a_page_of_nested_headers_is_one_walk():
    n = 30_000
    began = time.process_time()
    assert html.Page("<div><header>" * n + "x").text() == "" and html.Page("<article>" + "<div><header>" * n + "x").text() == "x"
    assert time.process_time() - began < 10


BIG = [(1 << 53) + 1, (1 << 53) + 3, None, 5, -((1 << 60) + 7)]


def test_ids_come_back_as_they_were(spark, documents, tmp_path):
    docs = documents([(i, f"text {k}", "en", "a") for k, i in enumerate(BIG)]).coalesce(1)
    key = lambda i: (i is not None, i or 0)
    ids = lambda df, c="doc_id": sorted((r[c] for r in df.select(c).collect()), key=key)
    wanted = sorted(BIG, key=key)
    assert ids(bpe.encoded(docs, BYTES)) == ids(bpe.encoded(docs, BYTES, ids=False)) == wanted
    assert ids(planes.token_files(docs, WORDS, folder=f"file://{tmp_path}/p", files=1)) == wanted
    pages = spark.createDataFrame([(i, "http://a.example", f"<p>{k}</p>") for k, i in enumerate(BIG)], "page_id long, url string, html string").coalesce(1)
    for held in (html.HELD_HASHES, 0):
        assert ids(html.main_text(pages, held_hashes=held), "page_id") == wanted
    assert sorted(r["doc_id"] for r in bpe.encoded(docs.filter("doc_id > 0").selectExpr("'x' || doc_id as doc_id", "text"), BYTES).collect()) == sorted(f"x{i}" for i in BIG if i and i > 0)


def test_pipeline_keeps_ids_and_takes_empty_tables(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "checkpoint_dir", lambda _: f"file://{tmp_path}/shared")
    many = [(1000 + i, ("vile awful insult " if i % 4 == 1 else "") + f"plain words number {i} of this small corpus here", "en", "a") for i in range(40)]
    rows = [(i, None if k == 3 else "" if k == 4 else f"some own text with the number {k} in it and more", "en", "a") for k, i in enumerate(BIG)]
    for name, docs in (("full", rows + many), ("none", [])):
        documents(docs).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1000 + i, 1, int(i % 4 == 1)) for i in range(40)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/full").collect()}
    assert kept and kept <= {*BIG, *(r[0] for r in many)} and {(1 << 53) + 1, (1 << 53) + 3} & kept


def test_pipeline_by_its_stages(spark, documents, tmp_path):
    rng = np.random.default_rng(9)
    line = lambda k: " ".join(rng.choice([f"w{j}" for j in range(300)], k))
    rows = [(i, f"{line(30)}\n{line(30)}", "en", f"s{i % 8}") for i in range(240)]
    rows = [(i, t + "\nSubscribe to all of our sites" if i % 3 == 0 else t, la, s) for i, t, la, s in rows]
    rows = [(i, t.replace("w", "vile w", 2) if i % 6 == 1 else t, la, s) for i, t, la, s in rows]
    rows += [(300 + i, rows[2][1], "en", "s1") for i in range(4)]
    folder = tmp_path / "sf"
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 1)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, columns, kept = spark.read.parquet(f"{folder}/documents.parquet"), corpus_pipeline.COLUMNS, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(folder))
        assert name == "bpe" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.toPandas().sort_values("doc_id")
    assert set(kept["toxicity"].doc_id) == {r[0] for r in rows if not (r[0] < 240 and r[0] % 6 == 1)}
    boiler = kept["line_dedup"][kept["line_dedup"].text.str.contains("Subscribe")]
    assert boiler.doc_id.tolist() == [0] and (kept["line_dedup"].n_chars == kept["line_dedup"].text.str.len()).all()
    copies = [2, 300, 301, 302, 303]
    assert kept["simhash"].doc_id[kept["simhash"].doc_id.isin(copies)].tolist() == [2]
    assert len(kept["simhash"]) == len(kept["line_dedup"]) - 4
    words = lambda df: df.text.str.split().str.len().sum()
    assert abs(words(kept["mixing"]) - 1.5 * words(kept["simhash"])) < 200 and kept["mixing"].doc_id.value_counts().max() == 2
    library = Tokenizer.from_file(BYTES)
    texts = dict(zip(kept["mixing"].doc_id, kept["mixing"].text))
    assert len(kept["bpe"]) == len(kept["mixing"])
    assert all(list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in kept["bpe"].itertuples())


def test_only_the_last_table_of_a_run_stays(spark, documents, tmp_path, monkeypatch):
    documents(MESSY).write.parquet(f"{tmp_path}/documents.parquet")
    step = lambda spark, docs, sf_dir: docs.filter("text is not null")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", step), ("b", step), ("c", step)])
    monkeypatch.setattr(corpus_pipeline, "checkpoint_dir", lambda _: f"file://{tmp_path}/shared")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == len(MESSY) - 1
    assert [p.name for p in tmp_path.glob("shared/pipeline-*/*")] == ["2-c"]


def test_stages_use_the_operators():
    assert corpus_pipeline.toxicity is toxicity and corpus_pipeline.simhash is simhash
