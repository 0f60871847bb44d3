"""Secret scans against a scan with Python's regular expressions."""

import collections
import hashlib
import re

from voxframe.llm import secrets
from voxframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def live(v):
    return bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= 10)


def brute(rows):
    """rows: (doc_id, text, owner); the digest of each."""
    found, repos = [], collections.defaultdict(dict)
    for _, text, owner in rows:
        text = text or ""
        base = [(m.start(), k, m.end(), m.group(g)) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text) if len(m.group(g)) >= n]
        runs = [(m.start(), 3, m.end(), m.group()) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text)]
        runs = [r for r in runs if live(r[3]) and not any(b[0] < r[2] and r[0] < b[2] for b in base)]
        found.append((base, runs))
        for s in base + runs:
            repos[s[3]].setdefault(text, owner or "")
            repos[s[3]][text] = min(repos[s[3]][text], owner or "")
    out = []
    for (doc, _, _), (base, runs) in zip(rows, found):
        example = lambda s: len(set(repos[s[3]].values())) >= 3 or len(repos[s[3]]) >= 10
        show = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in sorted(spans))
        out.append((
            doc, *[sum(s[1] == k for s in base) for k in range(3)], hashlib.sha256(show(base).encode()).hexdigest(),
            show(base + [r for r in runs if not example(r)]),
            sum(live(s[3]) and not example(s) for s in base + runs), sum(map(example, base + runs)),
        ))
    return sorted(out, key=str)


def test_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = sorted(map(tuple, QUERIES["op2_secrets"](spark, SF).collect()), key=str)
    assert got == brute(rows)


def test_cases(spark):
    key = "AKIA" + "Z9Y8X7W6V5U4T3S2"
    loose = "Qw3rTy7uIoP9aSdF1gHjK2"
    texts = [
        f'é😀 token = "{loose}" end', 'Password:"short" api_key="abcdefghijkl" APIKEY=aaaaaaaaaaaa.b', "token=token: abcdefghijklmn",
        "token=secret=abcdefghijkl passwd==abcdefghijklm", f"{key} AKIASHORT {key}0", "deadbeefdeadbeefdeadbeef 0123456789abcde 0123456789abcdef",
        f"seen here {loose} and {'-' * 30} and {'word' * 8}", "", None, "ſecret: abcdefghijklmnop", "x" * 200_000 + f" secret:{loose}",
        "token: " + "a" * 50_000, f"secret='{key}' deadbeefdeadbeef", "token:\tabcdefghijklm", "token  :  abcdefghijklm",
    ]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(texts)] + [(None, f"copied {loose}x9", o) for o in ("a", "b", "c", None)]
    rows += [(7, texts[0], None), (7, texts[0], None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, hash int, base string")
    assert sorted(map(tuple, secrets.digest(df).collect()), key=str) == brute(rows)
    assert secrets.digest(df.limit(0)).collect() == []


def test_owners_and_repositories(spark):
    hot, copied, few, many = (f"{c}w3rTy7uIoP9aSdF1gHjK2" for c in "QRST")
    rows = [(i, f"text {i} with {hot} in it", "one source") for i in range(300)]  # a placeholder within one owner
    rows += [(1000 + i, f"a document that was copied, {copied}", f"s{i}") for i in range(4)]  # one repository
    rows += [(2000 + i, f"text {i} with {few} in it", "one source") for i in range(3)]
    rows += [(3000 + i, f"text {i} with {many} in it", f"s{i}") for i in range(3)]  # three owners
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, hash int, base string")
    got = {r.doc_id: r for r in secrets.digest(df).collect()}
    live = {d for d, r in got.items() if r.n_live}
    assert live == {*range(1000, 1004), *range(2000, 2003)}
    assert {d for d, r in got.items() if r.n_example} == {*range(300), *range(3000, 3003)}
    assert all(("owned:" in r.spans) == (d in live) for d, r in got.items())
    assert sorted(map(tuple, got.values()), key=str) == brute(rows)


def test_many_matches_in_one_text(spark):
    """Places stay right over many chunks, and time grows with the matches, not with their square."""
    text = " ".join(f"é{i} token={'abcdefghijkl' if i % 3 else 'short'}{i % 7}" for i in range(30_000))
    rows = [(0, text, "s"), (1, " ".join(text.split()[:2 * secrets.CHUNK]), "s"), (2, " ".join(text.split()[:2 * secrets.CHUNK + 2]), "s")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, hash int, base string")
    assert sorted(map(tuple, secrets.digest(df).collect()), key=str) == brute(rows)
