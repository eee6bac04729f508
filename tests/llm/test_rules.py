"""Line-frequency rules and winnowing against brute force."""

import random
import re
from collections import Counter, defaultdict

from voxarbor.llm import decontaminate, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


def plain_kept(rows, least, left):
    """``kept`` of ``(id, text, host)`` rows."""
    def norm(line):
        return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line)).strip().lower()

    seen, out = defaultdict(set), []
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                seen[host or "", norm(line)].add(text)
    for i, text, host in rows:
        n, *_, again = plain_measures(text)
        cut = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if WORD.search(x)
                  and len(seen[host or "", norm(x)]) >= least)
        out.append((i, not (n < 20 or 100 * again > 30 * n) and n - cut >= left * n))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice("ab cd# ef 7 gh| É".split()) for _ in range(rnd.randrange(1, 25))) for _ in range(12)]
    return [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(7))), rnd.choice(["a", "b", None])) for i in range(n)]


def test_measures_and_verdicts(docs):
    rows = corpus(1)
    got = rules.judge(docs([(i, t, None, h) for i, t, h in rows]), least=5).collect()
    want = dict(plain_kept(rows, 5, 0.2))
    assert {r.doc_id: r.kept for r in got} == want and 0 < sum(want.values()) < len(want)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(rows[r.doc_id][1])


def test_the_limit_does_not_grow_with_the_host(docs, spark):
    """A line in 60 of 50,000 documents of one host is cut, and a document made of it is not kept."""
    line = " ".join(f"notice{i}" for i in range(40))
    df = spark.range(50_000).selectExpr(
        "id AS doc_id", "translate(cast(id AS string), '0123456789', 'abcdefghij') AS n", "'a' AS source").selectExpr(
        "doc_id", "source", f"CASE WHEN doc_id < 60 THEN concat('own words ', n, chr(10), '{line}') ELSE array_join("
        "transform(sequence(1, 25), i -> concat('w', n, substr('abcdefghijklmnopqrstuvwxyz', i, 1))), ' ') END AS text")
    got = rules.judge(df).groupBy("kept", "n_cut_words").count().collect()
    assert sorted((r.kept, r.n_cut_words, r["count"]) for r in got) == [(False, 40, 60), (True, 0, 49_940)]


def test_exact_copies_do_not_make_a_line_frequent(docs):
    text = " ".join(f"w{i}" for i in range(30))
    assert all(r.kept for r in rules.judge(docs([(i, text, None, "a") for i in range(50)]), least=5).collect())


def test_rules_odd_rows(odd, none):
    got = {r.doc_id: r for r in rules.judge(odd).collect()}
    assert rules.judge(odd).count() == 10 and not got[1].kept and got[1].n_words == 0 and got[8].n_repeat_words == 30_000
    assert rules.judge(none).count() == 0


def plain_marks(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for i, t in items:
        w = words(t)
        m = min(13, len(w))
        windows.setdefault(str(i), set()).update(tuple(w[k:k + m]) for k in range(len(w) - m + 1) if m)
    out = {}
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for i, own in windows.items():
            for g in own:
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k:k + len(g)]) == g:
                        hit.update(range(k, k + len(g)))
                        named.add(i)
        out[d] = (len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_winnowing_finds_every_window(docs, spark):
    rnd = random.Random(4)
    vocab = [f"W{i}" for i in range(9)] + ["É", "é", "3"]

    def some(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    items = [(i, some(rnd.choice([1, 2, 4, 12, 13, 14, 20, 40]))) for i in range(14)] + [(99, None), (98, "..."), (3, "again 3 times x")]
    texts = []
    for i in range(80):
        parts = [some(rnd.randrange(40))]
        for _ in range(rnd.randrange(3)):
            w = (rnd.choice(items)[1] or "").split()
            a = rnd.randrange(len(w) + 1)
            parts += [" ".join(w[a:a + rnd.randrange(10, 30)]), some(rnd.randrange(20))]
        texts.append((i, ", ".join(parts)))
    want = plain_marks(texts, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated)
           for r in decontaminate.mark(docs(texts), bench).collect()}
    assert got == want and any(w[3] for w in want.values())


def test_decontamination_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, "one word"), (2, None), (None, "no id here")], "item_id long, text string")
    got = decontaminate.mark(odd, bench)
    assert got.count() == 10 and sorted((r.doc_id, r.n_hit) for r in got.where("n_hit > 0").collect()) == [(4, 2), (4, 2)]
    assert decontaminate.mark(none, bench).count() == 0
    assert decontaminate.mark(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_items_without_an_id_are_hit(docs, spark, tmp_path):
    import corpus_pipeline
    from voxarbor.llm import queries

    long = " ".join(f"w{chr(97 + i)}" for i in range(20))
    rows = docs([(1, "one word"), (2, f"see {long}"), (3, "no id here"), (4, "clean text of its own"), (5, "one word no id here")])
    rows.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one word"), (None, "no id here"), (None, long), (None, None)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in queries.op10_winnowing(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 1, True), 2: (20, 1, True), 3: (3, 1, True), 4: (0, 0, False), 5: (5, 2, True)}
    kept = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r.doc_id for r in kept.collect()] == [4]
