import hashlib
import random
import re
from collections import defaultdict

import pytest
import regex
from hypothesis import given, settings, strategies as st

from stocklens.llm import pii

#: The contract's patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_valid(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_base(text):
    return [(n, m.start(), m.end()) for n, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text) if plain_valid(kind, m[0])]


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def plain_seen(text):
    """Seeds and candidates with their contexts."""
    matches = list(regex.finditer(pii.CANDIDATE, text, regex.ASCII))
    borders = [0, *(m.end() for m in matches)], [*(m.start() for m in matches), len(text)]
    parts = [text[a:b] for a, b in zip(*borders, strict=True)]
    for k, m in enumerate(matches):
        name = m[0]
        seed = next((n for n, kind in enumerate(pii.KINDS) if re.fullmatch(PLAIN[kind], name) and plain_valid(kind, name)), None)
        if seed is None:
            long = sum(c.isascii() and c.isalnum() for c in name) >= 6 and sum(c in "0123456789" for c in name) >= 4
            inner = any(re.search(PLAIN[kind], name) for kind in ("email", "ip", "phone")) or re.search(r"[0-9]([ -]?[0-9]){15}", name)
            if len(name) > 64 or not (long or "@" in name) or inner:
                continue
        left, right = ([w for w in re.split(r"\s+", re.sub("[1-9]", "0", part.lower()), flags=re.ASCII) if w] for part in (parts[k][-80:], parts[k + 1][:80]))
        made = [" ".join([*left[-2:], "_"]) if len(left) >= 2 else "", f"{left[-1]} _ {right[0]}" if left and right else "", " ".join(["_", *right[:2]]) if len(right) >= 2 else ""]
        yield m.start(), m.end(), name, seed, {p for p in made if p}


def plain_trusted(edges, rounds=4, least_sure=700, least_support=5):
    patterns, known, trusted = defaultdict(set), {}, {}
    for pattern, name, seed in edges:
        patterns[pattern].add((name, seed))
    for _ in range(rounds):
        trusted = {}
        for pattern, members in patterns.items():
            sums = [sum(1000 if seed == kind else known[name][1] if seed is None and name in known and known[name][0] == kind else 0 for name, seed in members) for kind in range(4)]
            kind = max(range(4), key=lambda k: (sums[k], -k))
            sure = sums[kind] // (len(members) + 1)
            if len(members) >= least_support and sure >= least_sure and sums[kind] >= 1000 * least_support:
                trusted[pattern] = (kind, sure)
        found = defaultdict(list)
        for pattern, (kind, sure) in trusted.items():
            for name, seed in patterns[pattern]:
                if seed is None:
                    found[name].append((sure, -kind))
        known = {name: (-max(all_)[1], max(all_)[0]) for name, all_ in found.items()}
    return trusted


def plain_find(texts):
    seen = [list(plain_seen(t)) for t in texts]
    trusted = plain_trusted({(p, name, seed) for found in seen for _, _, name, seed, patterns in found for p in patterns})
    out = []
    for text, found in zip(texts, seen, strict=True):
        base, added = plain_base(text), []
        for start, end, _, seed, patterns in found:
            sure = [(trusted[p][1], -trusted[p][0]) for p in patterns if p in trusted]
            if seed is None and sure and not any(a < end and start < b for _, a, b in base):
                added.append((-max(sure)[1], start, end))
        out.append((base, sorted(added)))
    return out


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.added]) for r in pii.find(docs).collect()}
    return [rows[k] for k in range(len(texts))]


def corpus(seed=3):
    """Texts with known identifiers in lexical contexts, and unknown ones beside: member numbers, local phone numbers."""
    rng = random.Random(seed)
    word = lambda: rng.choice(" ".join(f"word{chr(97 + k)}{chr(97 + j)}" for k in range(7) for j in range(7)).split())
    phone = lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    local = lambda: f"0{rng.randint(100, 999)}-{rng.randint(1000000, 9999999)}"
    mail = lambda: f"{word()}.{rng.randint(10, 99)}@{word()}.example.com"
    odd_mail = lambda: f"{word()}{rng.randint(10, 99)}@{word()}"
    order = lambda: f"AB{rng.randint(1000, 9999)}-{rng.randint(100, 999)}"
    ip = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    out, hidden = [], []
    for k in range(200):
        name, kind = (local(), "phone") if k % 9 == 0 else (phone(), None)
        out.append(f"{word()} {word()} please call me at {name} before noon {word()}")
        hidden += [(len(out) - 1, name, "phone")] if kind else []
        name, kind = (odd_mail(), "email") if k % 8 == 0 else (mail(), None)
        out.append(f"{word()} you can write to {name} about it, {word()} {word()}")
        hidden += [(len(out) - 1, name, "email")] if kind else []
        out.append(f"{word()} the order number {order()} was shipped {word()} on {rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}")
        out.append(f"{word()} {word()} {ip()} {word()} {order()} {word()} {word()}")
    return out, hidden


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1290.@-+_%( )é:\n", max_size=60))
def test_patterns_without_backtracking(text):
    for kind, pattern in pii.PATTERNS.items():
        assert [m.span() for m in regex.finditer(pattern, text)] == [m.span() for m in re.finditer(PLAIN[kind], text)]
        if re.search(PLAIN[kind], text) and kind != "card":
            assert re.search(pii.HINTS[kind], text)


def test_base_and_places(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 3)
    rng = random.Random(1)
    pieces = ["é", "\U0001f600", " ", "a@b.c", "..x@d-.e.f", "+1 (269) 555-3296", "4012888888881881", "4012 8888-8888 1881", "1.2.3.4", "256.1.1.1", "007.1.1.255", ".", "9", "x", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(n)) for n in (0, 1, 5, 40, 90) * 6]
    assert [base for base, _ in found(spark, texts)] == [plain_base(t) for t in texts]


def test_bootstrapping(spark):
    texts, hidden = corpus()
    got = found(spark, texts)
    assert got == plain_find(texts)
    added = {(k, texts[k][a:b], pii.KINDS[kind]) for k, (_, spans) in enumerate(got) for kind, a, b in spans}
    assert added == set(hidden) and len(hidden) > 40


def test_trust_spreads_and_stops(spark):
    edges = [("call _ now", f"s{k}", 3) for k in range(9)] + [("call _ now", "u1", None), ("call _ now", "u2", None)]
    edges += [("ring _ me", n, None) for n in ("u1", "u2", "u3")] + [("ring _ me", f"s{k}", 3) for k in range(5)]
    edges += [("of _ the", f"m{k}", k % 4) for k in range(20)] + [("of _ the", "u9", None), ("a _ b", "s1", 3), ("a _ b", "u8", None)]
    got = {r.pattern: (r.kind, r.sure) for r in pii.trusted(spark.createDataFrame(edges, "pattern string, instance string, seed int")).collect()}
    assert got == plain_trusted(edges) and set(got) == {"call _ now", "ring _ me"}
    alone = {r.pattern for r in pii.trusted(spark.createDataFrame(edges, "pattern string, instance string, seed int"), rounds=1).collect()}
    assert alone == {"call _ now"}


def test_time_grows_with_the_text(spark):
    texts = ["a" * 400_000, "1" * 300_000, "1." * 50_000, "a.b%" * 100_000 + "@", "+1" * 40_000, "+1 (" * 40_000, "1 " * 100_000, "a1-" * 100_000, "1.2.3.4 " * 10_000]
    got = found(spark, texts)
    assert [base for base, _ in got] == [[] if k < 8 and k != 2 else plain_base(t) for k, t in enumerate(texts)]


def test_query_on_documents(spark, sf_dir, documents):
    from stocklens.llm import registry

    rows = {r.doc_id: r for r in registry.queries()["op13_pii"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
    assert set(rows) == set(texts)
    for (doc_id, text), (base, added) in zip(texts.items(), plain_find(list(texts.values())), strict=True):
        r = rows[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest() and r.spans == joined(sorted(base + added)) and r.n_added == len(added)


def test_no_python_on_the_main_path(spark, sf_dir, documents):
    for frame in (pii.scanned(documents, "doc_id", "text"), pii.scan(documents)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_odd_rows(spark, odd_docs, no_docs, make_docs):
    rows = pii.scan(odd_docs).collect()
    assert len(rows) == 12 and pii.scan(no_docs).count() == 0 and pii.scan(no_docs).columns == pii.scan(odd_docs).columns
    assert {(r.spans, r.n_added, r.base_sha256) for r in rows} == {("", 0, hashlib.sha256(b"").hexdigest())}
    same = pii.scan(make_docs([(1, "x a@b.c"), (1, "x a@b.c"), (None, "1.2.3.4")])).collect()
    assert sorted((str(r.doc_id), r.spans) for r in same) == [("1", "email:2:7"), ("1", "email:2:7"), ("None", "ip:0:7")]


@pytest.mark.parametrize("digits, good", [("4012888888881881", True), ("4012888888881882", False), ("378282246310005", False), ("6011000990139424000", False)])
def test_luhn(spark, digits, good):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.is_valid("card", F.lit(digits))).first()[0] is (good and plain_valid("card", digits))
