"""Versions of pages against a plain program on generated edits."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from quillstone.operators import versions as V


def best_rise(places):
    """Length of a longest rising run, by trying all."""
    best = [0] * len(places)
    for i, p in enumerate(places):
        best[i] = 1 + max([best[j] for j in range(i) if places[j] < p], default=0)
    return max(best, default=0)


def plain_mates(a, b):
    """Mates by the three rounds, over lists."""
    mates = {}
    for kind in V.ROUNDS:
        back = {j: i for i, j in mates.items()}
        cuts_a, cuts_b = [-1, *sorted(mates), len(a)], [-1, *sorted(back), len(b)]
        for (i0, i1), (j0, j1) in zip(zip(cuts_a, cuts_a[1:]), zip(cuts_b, cuts_b[1:]), strict=True):
            named = []
            for items, lo, hi in ((a, i0, i1), (b, j0, j1)):
                seen, names = {}, {}
                for k in range(lo + 1, hi):
                    seen[items[k]] = seen.get(items[k], 0) + 1
                    name = (items[k], seen[items[k]]) if kind == "occurrence" else items[k]
                    names.setdefault(name, []).append(k)
                named.append({n: ks[0] for n, ks in names.items() if len(ks) == 1})
            pairs = sorted((i, named[1][n]) for n, i in named[0].items() if n in named[1])
            mates.update([pairs[k] for k in V.rising([j for _, j in pairs])])
    return mates


def plain_words(old, new):
    a, b = old.split(), new.split()
    mates, out, steps, j = plain_mates(a, b), [], [], 0
    for i in range(len(a) + 1):
        end = mates.get(i, len(b) if i == len(a) else None)
        if end is not None:
            steps += [("come", w) for w in b[j:end]]
            j = end + 1
        if i < len(a):
            steps.append(("stays" if i in mates else "gone", a[i]))
    for same, run in groupby(steps, key=lambda s: s[0] == "stays"):
        run = list(run)
        if same:
            words = [w for _, w in run]
            out.append(" ".join(words) if len(words) <= 6 else f"{' '.join(words[:3])} ... {' '.join(words[-3:])}")
        else:
            gone, come = ([w for k, w in run if k == kind] for kind in ("gone", "come"))
            out.append((f"[-{' '.join(gone)}-]" if gone else "") + (f"{{+{' '.join(come)}+}}" if come else ""))
    return " ".join(out)


def plain_compared(old, new):
    a, b = ([" ".join(x.split()) for x in (t or "").split("\n") if x.strip()] for t in (old, new))
    mates = plain_mates(a, b)
    back, words = {j: i for i, j in mates.items()}, []
    cuts_a, cuts_b = [-1, *sorted(mates), len(a)], [-1, *sorted(back), len(b)]
    for (i0, i1), (j0, j1) in zip(zip(cuts_a, cuts_a[1:]), zip(cuts_b, cuts_b[1:]), strict=True):
        if i1 - i0 == j1 - j0:
            words += [plain_words(a[i0 + k], b[j0 + k]) for k in range(1, i1 - i0)]
    n = len(a) + len(b)
    return len(a), len(b), a == b, round(200 * len(mates) / n, 1) if n else 100.0, len(b) - len(mates), len(a) - len(mates), words


def edited(rng, lines):
    out = []
    for line in lines:
        move = rng.random()
        if move < 0.1:
            continue
        if move < 0.25:
            words = line.split()
            words[rng.randrange(len(words))] = rng.choice(["new", "other", "x"])
            line = " ".join(words)
        out.append(line)
        if move > 0.9:
            out.append(rng.choice(["an added line", "same", line]))
    return out


def test_rising():
    rng = random.Random(1)
    for _ in range(200):
        places = rng.sample(range(30), rng.randrange(12))
        run = [places[i] for i in V.rising(places)]
        assert run == sorted(run) and len(run) == best_rise(places)


def test_versions_equal_a_plain_program(spark):
    rng = random.Random(4)
    rows = [(0, "a\nb", "a\nb"), (1, None, "x"), (2, "", ""), (3, "same\nsame\nsame", "same\nsame"), (4, "a\nb\nc", "c\nb\na"), (5, "# A\none two three\nsame\n# B\nx", "# A\none 2 three\nsame\n# C\ny")]
    for k in range(6, 60):
        lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) if rng.random() < 0.7 else "same" for _ in range(rng.randrange(1, 25))]
        rows.append((k, "\n".join(lines), "\n \n".join(edited(rng, lines))))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = {r.k: tuple(r)[1:] for r in V.compared(df.select("k", F.col("a").alias("t")), df.select("k", F.col("b").alias("t")), "k", "t").collect()}
    for k, a, b in rows:
        assert got[k] == plain_compared(a, b), (a, b)
    assert got[5][-1][0] == "one [-two-]{+2+} three"


def test_pages_and_metadata(spark):
    old = spark.createDataFrame([(1, "T", None, 3), (2, "U", "d", 4), (3, "V", "", 5)], "k int, title string, about string, n int")
    new = spark.createDataFrame([(1, "T2", "", 3), (2, "U", "d2", 7), (4, "W", "", 5)], "k int, title string, about string, n int")
    got = {tuple(r) for r in V.metadata_changes(old, new, "k", ["title", "about", "n"]).collect()}
    assert got == {(1, "title", "T", "T2"), (2, "about", "d", "d2"), (2, "n", "4", "7")}
    assert {tuple(r) for r in V.changes(old, new, "k").collect()} == {(3, "removed"), (4, "added")}
    assert V.compared(old.select("k", F.col("title").alias("t")).limit(0), new.select("k", F.col("title").alias("t")), "k", "t").count() == 0


def test_texts_are_made_once_and_only_crossed_gaps_leave_the_jvm(spark, monkeypatch):
    """Each side's texts are computed once, whatever the rounds; a gap whose anchors rise as they are never gets to rising()."""
    made, plans, write = spark.sparkContext.accumulator(0), [], V.materialise
    monkeypatch.setattr(V, "materialise", lambda df, tag: (plans.append(df._jdf.queryExecution().toString()), write(df, tag))[1])

    def slow(text):
        made.add(1)
        return text

    rows = [(i, f"one {i}\ntwo\nthree\nfour", f"two\none {i}\nthree {i}\nfour") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    side = lambda c: df.select("id", F.udf(slow, "string")(c).alias("text"))
    got = {r.id: (r.removed, r.added, list(r.words)) for r in V.compared(side("a"), side("b"), "id", "text").collect()}
    want = {i: plain_compared(a, b) for i, a, b in rows}
    assert got == {i: (w[5], w[4], w[6]) for i, w in want.items()}
    assert made.value == 40
    assert not any("FlatMapGroups" in p for p in plans) and any("ArrowEvalPython" in p for p in plans)
