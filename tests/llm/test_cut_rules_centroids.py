"""Fill-in-middle, URL rules and centroid clustering against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from nearopt.llm import centroids, fim, urlrules

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# ------------------------------------------------------------------------------------------------ fill-in-middle
def plain_fim(doc_id, text):
    text = text or ""
    hexed = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[k * 8 : k * 8 + 8], 16) for k in range(4))
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def _fim_rows():
    rng = random.Random(3)
    texts = ["", None, "x", "<P>", "a<S>b", "<", "<<P", "<S", "P>", "\n\r\n", "é\U0001f600e\u0301", "<M" * 50, "a\x00b", "\u2028\u2029\x85"]
    texts += ["".join(rng.choice("<PSM> a\né\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, "no id", None, None, None), (None, None, None, None, None), (9_000, "long <P text\n" * 100_000, "en", "s", 0)]


def test_fim_is_that_of_plain_python(spark):
    rows = _fim_rows()
    docs = spark.createDataFrame(rows, DOC).withColumns({"form": F.lit("clash"), "made": F.lit(1), "output": F.lit(2)})
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = [(r[0], *(p := plain_fim(r[0], r[1]))[:4], sha(p[4]), sha(r[1] or "")) for r in rows]
    got = [tuple(r) for r in fim.digest(docs).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert {r[2] for r in got} == set(fim.FORMS)
    out = fim.transform(docs)
    assert out.columns == [*docs.columns, "form_"]
    assert sorted(((r.doc_id, r.text, r.form_, r.form) for r in out.collect()), key=repr) == sorted(((r[0], (p := plain_fim(r[0], r[1]))[4], p[1], "clash") for r in rows), key=repr)
    assert fim.digest(docs.limit(0)).collect() == []


def test_fim_takes_other_units():
    words = regex.compile(r"\S+\s*")
    for text in ("", "  lead and trail  ", "one", "a b\nc  d", "   "):
        ends = list(fim.unit_ends(text, words))
        assert ends == sorted(ends) and (ends[-1:] == [len(text)] if text else ends == [])
        for key in range(60):
            output, form, n, a, m = fim.arranged(text, str(key), words, plain=100)
            assert fim.restored(output, form) == text and n == len(ends)
            assert form == "plain" or {a, a + m} <= {0, *ends}
    with pytest.raises(ValueError, match="form"):
        fim.restored("no marks", "psm")


# ------------------------------------------------------------------------------------------------ URL rules
def plain_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urlrules.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2], None
    for v, g in urlrules.GLOBS:
        if re.fullmatch(as_regex(g), f".{host}{path}"):
            return host, path, None, v, g
    return host, path, None, "allow", None


def as_regex(glob):
    parts = {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}
    return "".join(parts.get(p) or re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]", glob))


URLS = [
    None, "", "no scheme", "://", "http://", "file:///x/y", "http://org", "http://org/", "http://ORG/a", "http://xorg/", "http://a.org?x=/", "http://a.org#/", "http://a.b.Example.org/es/1", "http://example.org/es", "http://example.org/en/1999", "http://example.org/en/2",
    "http://badexample.org/es/", "http://x.com/fr/", "http://x.com/de/1", "http://x.com/it/", "http://x.net/", "http://evil.net/x.org/", "http://x.net/a.exe", "http://x.net/a.exe?b", "http://x.net/calendar/2024-01-02", "http://x.net/calendar/2024-01/02", "http://m.ads.net/", "http://ads.net/",
    "http://user@x.org:80/", "http://x.org./", "a://b://c.org/", "http://\u00c4.net/\u00e4", "http://x.net/\n.zip", "http://İ.org/", "http://x.net/p;jsessionid=1", "x" * 500_000 + "://a.org/", "http://a.net/" + "y/" * 20_000 + ".iso",
]


def test_rules_are_those_of_plain_python(spark):
    rng = random.Random(4)
    hosts = ["org", "example.org", "a.example.org", "com", "x.com", "b.com", "net", "ads.net", "m.ads.net", "a..org", ""]
    urls = URLS + ["http://" + rng.choice(hosts) + rng.choice(["", "/", "/es/", "/en/1", "/en/2", "/fr/", "/de/x", "/cgi-bin/a", "/b.zip", "?q=/es/", "#/de/"]) + rng.choice(["", ".exe", "?a", "/x"]) for _ in range(500)]
    rows = [(i, u, "<html>") for i, u in enumerate(urls)] + [(None, "http://a.org/", None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "row": F.lit(1), "Verdict": F.lit(2)})
    got = [tuple(r) for r in urlrules.judge(pages).collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain_judge(u)) for i, u, _ in rows), key=repr)
    assert {r[4] for r in got} == {"allow", "block"} and len({r[5] for r in got}) > 6
    kept = urlrules.keep_allowed(pages)
    assert kept.columns == pages.columns
    assert sorted((r.page_id, r.url) for r in kept.where("page_id is not null").collect()) == sorted((i, u) for i, u, _ in rows if i is not None and plain_judge(u)[3] == "allow")
    assert kept.where("page_id is null").count() == 2
    assert urlrules.judge(pages.limit(0)).collect() == []
    with pytest.raises(ValueError, match="verdict"):
        urlrules.judge(pages, default="maybe")


def test_all_wildcards_walk_like_regular_expressions():
    rng = random.Random(6)
    for _ in range(40):
        # Up to some 40 patterns of up to 80 elements: they begin, end and lie across the words' borders.
        globs = ["".join(rng.choice(["a", "b", "/", "?", "*", "**", "é"]) for _ in range(rng.choice([0, 1, 3, 6, 80]))) for _ in range(rng.randint(1, 40))]
        texts = ["".join(rng.choice("ab/éz") for _ in range(rng.choice([0, 1, 2, 5, 9, 90]))) for _ in range(60)]
        texts += ["".join(rng.choice("abz") if p in "*?" else p for p in rng.choice(globs)) for _ in range(30)]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        got = urlrules.Automaton(globs).matches(codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        wanted = [[bool(regex.fullmatch(as_regex(g), t)) for g in globs] for t in texts]
        assert got.tolist() == wanted


# ------------------------------------------------------------------------------------------------ centroids
def plain_cluster(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cents = [q for _, q in sorted(((hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest(), q) for i, q in kept))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((dist(q, c), j) for j, c in enumerate(cents)) for _, q in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(cents)):
            own = [q for (_, q), (_, w) in zip(kept, at) if w == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    inertia = {j: sum(d for d, w in at if w == j) for j in range(len(cents))}
    return [(i, w, d, inertia[w], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[w])).encode()).hexdigest()) for (i, _), (d, w) in zip(kept, at)]


VEC = "vec_id long, embedding array<float>, label int"


def _vectors(n, seed=1, width=64):
    rng = np.random.default_rng(seed)
    return [(i, np.float32(v).tolist()) for i, v in enumerate(rng.normal(size=(n, width)) + 3 * rng.integers(0, 3, size=(n, 1)))]


@pytest.mark.parametrize("n", [0, 1, 9, 200])
def test_clusters_are_those_of_plain_python(spark, n):
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [float("nan")] * 64), (904, [None, *[1.0] * 63]), (905, [float("inf"), *[0.0] * 63]), (906, [-float("inf"), *[0.0] * 63])]
    rows = _vectors(n)
    if n == 200:
        rows += [(907, [0.0] * 64), (None, [0.5] * 64), (None, [0.25] * 64), (5, [-1.0] * 64), *rows[:20], *rows[:20], (908, [3e5, *[-0.0] * 63])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], VEC).withColumns({"cluster": F.lit("clash"), "q": F.lit(1)}).repartition(5)
    got = sorted(map(tuple, centroids.cluster(table).collect()), key=repr)
    assert got == sorted(plain_cluster(rows + odd), key=repr)


def test_components_too_large_have_a_result(spark):
    rows = [(i, [s * 3e38] * 64, 1) for i, s in enumerate((1.0, -1.0, 0.5, 0.0))]
    got = centroids.cluster(spark.createDataFrame(rows, VEC)).collect()
    assert len(got) == 4 and all(r.distance == 0 for r in got)  # 1.0 and 0.5 are held at the same integer
    double = spark.createDataFrame([(1, [1e300] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert sorted(r.distance for r in centroids.cluster(double, k=1, rounds=0).collect())[-1] == 64 * (centroids.LARGEST - 64) ** 2


def test_partial_distances_give_the_full_search_and_save_work():
    rng = np.random.default_rng(8)
    scale = np.where(np.arange(64) % 8 == 0, 60, 6)
    c = np.round(rng.normal(size=(16, 64)) * scale).astype(np.int64)
    c[9], c[3] = c[2], c[11]  # ties go to the smaller number
    x = np.concatenate([c[rng.integers(0, 16, 3000)] + rng.integers(-9, 10, (3000, 64)), c, (c[:8] + c[8:]) // 2])
    order = np.argsort(-x.var(0), kind="stable")
    spent = []
    which, best = centroids.nearest(x, c, order, spent=spent)
    full = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert which.tolist() == full.argmin(1).tolist() and best.tolist() == full.min(1).tolist()
    assert spent[0] < 0.35 * full.size * 64
    assert not np.isin(which, (9, 11)).any()
