"""Page extraction on held-out layouts and awkward markup; the pipeline against brute force."""
import hashlib
import random
import re

import corpus_pipeline
from tests.llm.test_text_operators import AWKWARD, SF, brute_components, brute_hits, frame
from tests.llm.test_files_and_spans import base_spans
from tidewatch.llm import pages, quality
from tidewatch.llm.queries import BYTE_BPE, QUERIES
from tokenizers import Tokenizer


def article_text(html):
    """The article of the tables' one layout, read with expressions."""
    from html import unescape
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner))
    return "\n".join(t for t in (" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks) if t)


def test_main_text_of_all_pages(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = QUERIES["op9_main_text"](spark, SF).collect()
    assert len(found) == len(html)
    for r in found:
        assert r["text"] == article_text(html[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_other_layouts_and_decoding(spark):
    sample = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(100).collect()]
    model, rng = pages.fit(sample), random.Random(77)
    texts = [t for h in sample for t in pages.Page(h).text if t.count(" ") > 2]
    right = total = 0
    for _ in range(150):
        page = pages.Page(pages.skeleton(rng, texts))
        kept = page.decoded(model.predict(page.features()))
        assert all(not k or page.parent[i] < 0 or kept[page.parent[i]] for i, k in enumerate(kept))
        leaves = [(a, b) for a, b, t in zip(page.known(), kept, page.text) if t]
        right, total = right + sum(a == b for a, b in leaves), total + len(leaves)
    assert right > 0.96 * total
    body = "The first paragraph has enough words to be read. It goes on for a while, and on."
    odd = [None, "", "<", "<p", "no markup at all", "<html><body></body></html>", f"<body><article><p>{body}<p>Second &amp; third&nbsp;words<br>here.</article><div class='ad'>Buy now</div>", "<div>" * 3000 + "deep" + "</div>" * 3000,
           f"<script>if (a < b) document.write('<p>x</p>')</script><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{body}</p><p>{body}</p></article><!-- <p>gone</p> --><footer>end</footer>", "<p title='>\">" + body + "</p>"]
    out = pages.main_text([pages.Page(h) for h in odd], model)
    assert out[0] == out[1] == out[5] == "" and out[6] == f"{body}\nSecond & third words here." and out[8] == f"Title\n{body}\n{body}"
    rows = spark.createDataFrame([(k, f"u{k}", h, k) for k, h in enumerate(odd)], "page_id long, url string, html string, text long")
    got = {r["page_id"]: r["text"] for r in pages.extract(rows).collect()}
    assert len(got) == len(odd) and pages.extract(rows.limit(0)).count() == 0


def test_layout_of_div_elements_alone_is_read():
    rng = random.Random(5)
    words = "river stone market paper window garden letter morning winter simple travel number farmer bridge season station".split()

    def sentence(low, high):
        return " ".join(rng.choices(words, k=rng.randint(low, high))).capitalize() + "."

    def page():
        body = [" ".join(sentence(6, 14) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(3, 6))]
        links = "".join(f'<li><a href="#">{sentence(1, 2)}</a></li>' for _ in range(5))
        return f'<body><div class="menu"><ul>{links}</ul></div><div class="story">{"".join(f"<div>{b}</div>" for b in body)}</div><div class="footer">{sentence(3, 6)}</div></body>', "\n".join(body)

    made = [page() for _ in range(230)]
    model = pages.fit([h for h, _ in made[:200]])
    got = [(set(t.split("\n")), set(body.split("\n"))) for t, (_, body) in zip(pages.main_text([pages.Page(h) for h, _ in made[200:]], model), made[200:])]
    assert all(found <= wanted for found, wanted in got) and sum(len(found) for found, _ in got) > 0.96 * sum(len(wanted) for _, wanted in got)


def test_formulas_unclosed_elements_and_foreign_marks(spark):
    body = "The first paragraph has enough words to be read. It goes on for a while, and on."
    sample = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(100).collect()]
    odd = [f"<body><article><p>{body} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", *[f"<body><article><p>{body}</p><{t}><p>{body}</p><p>{body}</p></article>" for t in ("select", "svg", "math", "template")],
           *[f"<body data-keep={v}><article><p data-keep={v}>{body}</p></article>" for v in ('"true"', '""', "0")]]
    rows = spark.createDataFrame([(k, f"u{k}", h) for k, h in enumerate(odd + sample)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(rows).filter(f"page_id < {len(odd)}").collect()}
    assert [got[k] for k in range(len(odd))] == [f"{body} x=1 holds.", *["\n".join([body] * 3)] * 4, *[body] * 3]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    sf = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    accepted = {r["doc_id"] for r in quality.score_quality(read("documents"), read("labels")).filter("predicted = 1").collect()}
    docs = [d for d in docs if d[0] in accepted]
    kept = {eval(r)[0] for r in brute_components(docs) if eval(r)[3]}
    docs = [d for d in docs if d[0] in kept]
    hit = {eval(r)[0] for r in brute_hits(docs, [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]) if eval(r)[5]}
    docs = [d for d in docs if d[0] not in hit]
    tokenizer, expected = Tokenizer.from_file(BYTE_BPE), []
    for i, text in docs:
        out, at = "", 0
        for start, _, end, kind in base_spans(text):
            if start >= at:
                out += text[at:start] + f"<{kind}>"
            at = max(at, end)
        ids = tokenizer.encode(out + text[at:], add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()))
    assert sorted(expected) == sorted(tuple(r)[:3] for r in corpus_pipeline.run(spark, sf).collect())
    assert 0 < len(expected) < 200 and hit


def test_stages_take_awkward_rows_and_empty_tables(spark):
    for rows in (AWKWARD, []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() <= len(rows)
