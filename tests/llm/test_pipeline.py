"""The pipeline's stages on planted copies, and the whole against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from cairnset.llm import lines, mix, pieces, quality, simhash

from .test_llm import WORD, fresh, roots, slow_distance, slow_quality, targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(seed=1):
    rnd = random.Random(seed)
    text = lambda n: " ".join(f"v{rnd.randrange(3000)}" for _ in range(n))
    rows = [text(rnd.randint(60, 300)) for _ in range(60)]
    near = {}
    for i in range(20):
        w = rows[i].split()
        for _ in range(max(1, len(w) // 100)):
            w[rnd.randrange(len(w))] = "edit"
        near[len(rows)] = i
        rows.append(" ".join(w))
    for i in range(5):
        near[len(rows)] = i
        rows.append(rows[i])
    rows += ["too short", "", None, "spam spam spam " * 60]
    return [(i, t, "en", f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(rows)], near


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_stage(spark):
    rows, near = make()
    docs = spark.createDataFrame(rows, DOCS)
    out = cp.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    sure = {c for c, i in near.items() if jaccard(rows[c][1], rows[i][1]) >= 0.85}
    assert len(sure) > 15 and not kept & sure
    assert set(range(60)) <= kept
    groups = simhash.near_copies(spark.createDataFrame([*rows, (None, "x", None, None, 1), (3, rows[40][1], "", "", 1)], DOCS), bucket=3)
    got = {(r.doc_id, r.component_id) for r in groups.collect()}
    assert (40, 3) in got and (None, None) not in got
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_near_block_edits(spark):
    """Texts cut short or extended, down to a similarity of 0.8: those are found, less similar ones aren't."""
    rnd = random.Random(8)
    rows, near, far = [], set(), set()
    for i in range(150):
        w = [f"v{rnd.randrange(10**6)}" for _ in range(rnd.randint(100, 600))]
        n = int(len(w) * rnd.uniform(0.72, 0.95))
        k = w[:n] if i % 2 else [f"b{rnd.randrange(10**6)}" for _ in range(len(w) * len(w) // n - len(w))] + w
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(k))]
        (near if jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else far).add(2 * i + 1)
    groups = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 60 and len(far) > 30
    assert {i for i in near if groups[i] == i} == set() and {i for i in far if groups[i] != i} == set()


def test_near_one_print(spark):
    """More different texts of the same distinct words, so of one SimHash of those, than a bucket holds."""
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(40):
        w = list(base)
        w[4 * i], w[4 * i + 1] = w[4 * i + 1], w[4 * i]
        rows.append((i, " ".join(w)))
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), bucket=8).collect()
    assert len(got) == 40 and {r.component_id for r in got} == {0}


def test_near_recall(spark):
    """Near copies by scattered edits, from 0.8 on: at least nine in ten are found, texts under 0.75 stay."""
    rnd = random.Random(15)
    rows, near, far = [], set(), set()
    for i in range(120):
        w = [f"v{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 500))]
        k = list(w)
        for at in rnd.sample(range(len(k)), max(1, int(len(k) * rnd.uniform(0.005, 0.05)))):
            k[at] = f"e{rnd.randrange(10**6)}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(k))]
        j = jaccard(rows[-2][1], rows[-1][1])
        (near if j >= 0.8 else far if j < 0.75 else set()).add(2 * i + 1)
    kept = {r.doc_id for r in simhash.first_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 40 and len(far) > 10
    assert len(near & kept) <= 0.1 * len(near) and far <= kept and set(range(0, 240, 2)) <= kept


def test_first_copies_odd(spark):
    text = " ".join(f"v{i}" for i in range(80))
    names = ["doc_id", "text", "row", "version", "root", "times", "own", "a"]
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text + " x"), (5, "other"), (5, "more"), (7, None), (8, ""), (9, " "), (None, "none"), (None, "none")]
    frame = spark.createDataFrame([(*r, *["c"] * 6) for r in rows], "doc_id long, " + ", ".join(f"{c} string" for c in names[1:])).repartition(3)
    got = simhash.first_copies(frame)
    assert got.columns == names
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, text), (5, "other"), (5, "more"), (7, None), (None, "none")])
    assert simhash.first_copies(frame.limit(0)).count() == 0


def test_tokens_once(spark):
    """The text goes to the workers once and doesn't come back; ids are those of encode(), odd texts included."""
    rows = [(1, "one text of words"), (2, ""), (3, None), (1, "ünïcödé " * 40_000), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.tokens(spark, docs, "")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.split("\n") if "MapInArrow" in x)
    assert got.columns == ["doc_id", "ids", "n_tokens"] and "text#" not in line[line.rindex("[") :]
    assert sorted(map(str, got.collect())) == sorted(map(str, pieces.encode(docs).drop("text").collect()))


def test_stages_chain(spark):
    rows, _ = make(2)
    docs = spark.createDataFrame(rows, DOCS)
    good = cp.quality_rules(spark, docs, "")
    assert good.columns == docs.columns
    want = {r.doc_id for r in quality.rate(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == want and want >= set(range(60))
    slim = cp.line_dedup(spark, good, "")
    assert slim.columns == docs.columns and {r.text for r in slim.collect()} == {r.text for r in lines.dedup_lines(good).collect()}
    mixed = cp.mix_sources(spark, slim, "")
    assert mixed.columns == docs.columns
    taken = sum(r.taken for r in mix.mix(slim, block=cp.MIX_BLOCK).collect())
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect()) == taken
    ids = cp.tokens(spark, mixed, "")
    m = pieces.Model.load()
    assert sorted(m.decode(r.ids) for r in ids.collect()) == sorted(r.text for r in mixed.collect())


def slow_lines(rows):
    """Rows without lines that occur earlier, or nearly so, by edit similarity of all pairs."""
    norm = sorted({x.strip(" \t\r\x0b\x0c").lower() for _, t, *_ in rows for x in t.split("\n")} - {""})
    near = [(a, b) for i, a in enumerate(norm) for b in norm[i + 1 :] if (m := max(len(a), len(b))) and min(len(a), len(b)) >= 0.8 * m and len(set(a.split()) & set(b.split())) * 3 > len(set(a.split())) and slow_distance(a, b) <= int(0.2 * m + 1e-9)]
    group, seen, out = roots(norm, near), {}, []
    for r in sorted(rows):
        keep = [x for n, x in enumerate(r[1].split("\n")) if not (k := x.strip(" \t\r\x0b\x0c").lower()) or seen.setdefault(group[k], (r[0], n)) == (r[0], n)]
        if re.search(WORD, "\n".join(keep)):
            out.append((r[0], "\n".join(keep), *r[2:]))
    return out


def slow_near(rows):
    sets = {r[0]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in rows for w in [r[1].lower().split()]}
    group = roots([r[0] for r in rows], [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.8 * len(x | y)])
    return [r for r in rows if group[r[0]] == r[0]]


def test_run_plain(spark, tmp_path):
    """All stages against plain Python versions; the mix, whose blocks are seeded, by its targets and by what its texts may hold."""
    import sentencepiece

    rnd = random.Random(9)
    shared = [fresh(8, rnd) for _ in range(5)]
    rows = []
    for i in range(40):
        own = [fresh(rnd.randint(20, 40), rnd) for _ in range(3)]
        own.insert(rnd.randrange(4), rnd.choice(shared) + rnd.choice(["", "s", "!"]))
        rows.append((i, "\n".join(own), "en", f"s{i % 3}", 0))
    for i in range(10):  # near copies: the lines in one, so that the line stage leaves them
        rows.append((100 + i, rows[i][1].replace("\n", " ") + " " + fresh(2, rnd), "en", "s1", 0))
    rows += [(200, "spam spam spam " * 60, "en", "s1", 0), (201, "short", "en", "s2", 0), (202, None, "en", None, 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    want = slow_near(slow_lines([r for r in rows if slow_quality(r[1])["kept"]]))
    step = spark.read.parquet(f"{folder}/documents.parquet")
    for _, f in cp.STAGES[:3]:
        step = f(spark, step, folder)
    assert sorted((r.doc_id, r.text) for r in step.collect()) == sorted(r[:2] for r in want) and len(want) < 50
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    of, sizes, taken = {r[0]: r for r in want}, defaultdict(int), defaultdict(int)
    for r in want:
        sizes[r[3]] += len(r[1].split())
    out = cp.run(spark, folder).collect()
    for r in out:
        text = sp.decode(r.ids)
        assert sp.encode(text) == r.ids and r.n_tokens == len(r.ids) and r.n_chars == len(text) and r.source == of[r.doc_id][3]
        words = iter(of[r.doc_id][1].split())
        assert all(w in words for w in text.split())  # a part of the text, in order
        taken[r.source] += len(text.split())
    for source, x in targets(sizes).items():
        assert abs(taken[source] - x) <= 64 + 0.04 * x


@pytest.mark.parametrize("n", [0, 1])
def test_run(spark, tmp_path, n):
    rows, _ = make(3)
    folder = str(tmp_path)
    spark.createDataFrame(rows[: len(rows) * n], DOCS).write.parquet(f"{folder}/documents.parquet")
    out = cp.run(spark, folder)
    step = spark.read.parquet(f"{folder}/documents.parquet")
    for _, f in cp.STAGES:
        step = f(spark, step, folder)
    assert sorted(map(str, out.collect())) == sorted(map(str, step.collect()))
