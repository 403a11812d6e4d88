"""Pages and file formats."""

from __future__ import annotations

import hashlib
import random
import uuid

import numpy as np
import plain
import pytest
import zstandard

from flowtide.llm import common, labelled, maintext, rangecoder, tokens, warc

PAGE = "page_id long, url string, html string, digest string, first long"


def pages(spark, rows):
    return common.prepare(spark).createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], PAGE)


def test_archives(spark, tmp_path):
    r = random.Random(1)
    big = "".join(r.choice("abcdef \r\n") for _ in range(400_000))
    rows = [(i, f"http://x/{i}\r\nX: y", "é" * 60 if i % 3 == 0 else "small" if i % 3 == 1 else f"page {i} " * 40) for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (52, "u", big), (53, "u", big), (2, "u", "page 2 " * 40), (None, "u", "é" * 60), (None, "u", "WARC/1.1\r\n\r\n" * 30)]
    path = f"{tmp_path}/w"
    warc.write_archives(pages(spark, rows), path)
    got = sorted((tuple(x[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for x in warc.read_archives(spark, path).collect()), key=str)
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 100 and data in first and i != first[data]
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    assert got == sorted(want, key=str)


def test_a_record_is_found_by_its_identifier_and_any_reader_can_read_on():
    bundle = warc.Bundle()
    payloads = [(f"payload {i} " * (i * 300 + 1)).encode() for i in range(60)]
    for i, p in enumerate(payloads):
        digest = hashlib.sha256(p).hexdigest()
        bundle.add(warc.record_id(i, digest), warc.record(i, "u", p, digest, len(p), None))
    data = bundle.close() + warc.MAGIC
    reader = warc.Reader(data)
    assert len(reader.starts) > 3
    for i in (40, 3, 59):
        fields, payload = warc.parse_record(reader.find(warc.record_id(i, hashlib.sha256(payloads[i]).hexdigest())))
        assert payload == payloads[i] and fields["X-Page-ID"] == str(i)
    stream = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert stream.count(b"WARC/1.1") == 60
    with pytest.raises(KeyError):
        reader.find(uuid.uuid4())
    with pytest.raises(ValueError):
        warc.Reader(data[:-1] + b"x")


def test_an_empty_table_of_pages(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write_archives(pages(spark, []), path)
    assert warc.read_archives(spark, path).collect() == []
    assert maintext.extract(pages(spark, [])).collect() == []


@pytest.mark.parametrize("kind", ["random", "repeating", "constant", "one", "none"])
def test_blocks_come_back(kind):
    r = np.random.default_rng(4)
    ids = {
        "random": r.integers(0, 1 << 16, 30_000), "repeating": np.tile(r.integers(0, 50_000, 700), 40)[:26_000],
        "constant": np.full(9000, 65535), "one": np.array([7]), "none": np.zeros(0),
    }[kind].astype(np.uint16)
    docs = [(5, len(ids)), (None, 0)] if len(ids) else []
    data = rangecoder.encode_file(ids, docs, 3, 2) + rangecoder.END
    part, number, back, found = rangecoder.decode_file(data)
    assert (part, number, found) == (3, 2, docs) and back.tolist() == ids.tolist()
    if kind == "repeating":
        assert len(data) < 1.2 * len(ids)


def test_a_damaged_block_is_noticed():
    data = bytearray(rangecoder.encode_file(np.arange(9000).astype(np.uint16), [(1, 9000)], 0, 0) + rangecoder.END)
    data[rangecoder.HEAD.size + 100] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode_file(bytes(data))


def test_token_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(rangecoder, "FILE_IDS", 3000)
    r = random.Random(6)
    texts = [" ".join(r.choice(["alpha", "beta.", "Gamma,", "été", '"', '"x']) for _ in range(r.choice([0, 1, 30, 900]))) for _ in range(50)] + [None, ""]
    ids = list(range(0, 104, 2))
    r.shuffle(ids)
    docs = common.prepare(spark).createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, part int")
    path = f"{tmp_path}/t"
    rangecoder.write_ids(docs, path)
    tok = Tokenizer.from_file(tokens.vocabulary_path())
    want, at = [], 0
    for i, t in sorted(zip(ids, texts, strict=True)):
        own = plain.token_ids(tok, t)
        want.append((i, at, len(own), plain.crc(own)))
        at += len(own)
    got = rangecoder.checksums(rangecoder.read_ids(spark, path)).collect()
    assert sorted(map(tuple, got)) == want
    empty = f"{tmp_path}/e"
    rangecoder.write_ids(docs.limit(0), empty)
    assert rangecoder.checksums(rangecoder.read_ids(spark, empty)).collect() == []


@pytest.fixture(scope="module")
def model():
    return maintext.trained()


def test_blocks_of_unseen_labelled_pages(model):
    right = total = 0
    for page in labelled.pages(150, seed=7):
        marked = [labelled.CONTENT in n.text for n in maintext.Page(page).nodes if n.tag == maintext.TEXT]
        nodes = maintext.Page(page.replace(labelled.CONTENT, "").replace(labelled.OTHER, "")).nodes
        found = [p > 0.5 for n, p in zip(nodes, model.marginals(nodes), strict=True) if n.tag == maintext.TEXT]
        assert len(marked) == len(found)
        right += sum(a == b for a, b in zip(marked, found, strict=True))
        total += len(marked)
    assert right / total > 0.98


def test_marginals_equal_the_sum_over_all_states(model):
    from itertools import product
    from math import exp

    nodes = maintext.Page("<body><nav><a href=x>Home</a></nav><div class=post><p>Some words stand here. And more of them.</p></div></body>").nodes
    seen = maintext.observe(nodes)
    mass, total = [0.0] * len(nodes), 0.0
    for state in product((0, 1), repeat=len(nodes) - 1):
        state = (1, *state)
        weight = sum(model._moves(nodes[n.parent].tag, n.tag)[state[n.parent]][state[i]] for i, n in enumerate(nodes) if i)
        for i, n in enumerate(nodes):
            if i:
                weight += (maintext.BLOCK_WEIGHT if n.tag == maintext.TEXT else 1) * sum(model.shown.get(w, (0, 0))[state[i]] for w in seen[i])
        total += exp(weight)
        for i, s in enumerate(state):
            mass[i] += s * exp(weight)
    got = model.marginals(nodes)
    assert all(abs(m / total - g) < 1e-6 for m, g in zip(mass[1:], got[1:], strict=True))


ARTICLE = """<html><head><title>No</title><style>p{}</style></head><body><div class="cookie-banner"><p>We use cookies. Accept them all please.</p></div>
<header class="site-header"><div>The Paper</div><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav></header>
<div class="sidebar"><h3>Related</h3><ul><li><a href=3>Three things</a></ul></div>
<article><h1>A   title &amp; more</h1><p>First&nbsp;paragraph\n with <b>bold</b>,<br>a break and <a href=4>a link</a>. It goes on for a while.<p>Second &lt;one&gt; &#233;t&eacute;.
<div class="advert">Buy now! It is cheap.</div><ul><li>point a<li>point b</ul><script>var p="</p>";</script></article>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I like this very much, thank you.</p></div></section>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; The Paper. All rights.</footer>"""


def test_main_text(spark, model):
    want = "A title & more\nFirst paragraph with bold, a break and a link. It goes on for a while.\nSecond <one> été.\npoint a\npoint b"
    assert maintext.main_text(ARTICLE, model) == want
    rows = [(1, "u", ARTICLE), (1, None, ARTICLE), (2, "v", None), (3, "w", ""), (None, "x", "<p"), (4, "y", "<div>" * 3000 + "deep" + "</p>" * 3000)]
    got = maintext.extract(pages(spark, rows)).collect()
    assert [(r["page_id"], r["url"]) for r in got] == [(i, u) for i, u, _ in rows]
    assert got[0]["text"] == got[1]["text"] == want and got[0]["n_chars"] == len(want)
    assert [(r["text"], r["n_chars"]) for r in got[2:4]] == [("", 0)] * 2
