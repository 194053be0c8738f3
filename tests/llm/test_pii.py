import hashlib
import re

from tastegrid.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            spans.append((m.start(), rank, m.end(), kind))
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return [sum(k == kind for *_, k in spans) for kind in PATTERNS], joined


TEXTS = [
    "mail a.b+c@x-y.example.com, c_d@e.f_g@h.i and a@b.c.d@e.f; no@dot @x.y z@.q a@b-.c-d",
    "1.2.3.4 256.1.1.1 001.02.0003.255 1.2.3.4.5.6.7.8 12.34.56 9999999999999.1.1.1 0.0.0.0.",
    "4111 1111 1111 1111, 4111-1111-1111-1112 and 79927398713 or 00000000000000 4242424242424242424 1 2 3",
    "+1 (017) 555-7713 +49.30.1234567- +1 +12 +1234567890123456 ++1 2345678901 (+44) 20 7946 0958)",
    "é😀 x@y.zz 😀 +1 (017) 555-7713 é",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and joe [at] mail [dot] com, call 555-123-4567",
    "1" * 3000 + ".1.1.1 " + "a" * 3000 + "@b.c" + ".d" * 20_000,
    "+1" * 2000 + " 1-1" * 3000,
]


def test_base_spans_equal_the_patterns(spark, documents, odd):
    rows = [(100 + i, t, "s") for i, t in enumerate(TEXTS)] + odd
    got = pii.digest(pii.find(documents(rows))).collect()
    want = sorted((str(i), *plain(t)[0], hashlib.sha256(plain(t)[1].encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        base = [x for x in plain({i: t for i, t, _ in rows}[r.doc_id])[1].split(",") if x] if r.doc_id and r.doc_id >= 100 else []
        spans = r.spans.split(",")
        assert set(base) <= set(spans) and [x for x in spans if x in base] == base


def test_the_method_adds_secrets_and_leaves_words_alone(spark, documents):
    rows = [(i, f"the key value {i}: token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" was set", "s") for i in range(40)]
    rows += [(100 + i, f"plain-words-with-hyphens-and-more-{i} are no secret in chapter {i}", "s") for i in range(40)]
    got = {r.doc_id: [x for x in r.spans.split(",") if x] for r in pii.digest(pii.find(documents(rows))).collect()}
    assert all([x.split(":")[0] for x in got[i]] == ["secret"] for i in range(40))
    assert not any(got[100 + i] for i in range(40))


def test_reliable_labelers_get_weight():
    good = {("secret", (0, 1, 1, 1, 1)): 500, ("secret", (0, 0, 0, -1, 1)): 480, ("secret", (0, 1, 1, 1, -1)): 20}
    posterior = pii.reliabilities(good)
    assert posterior["secret", (0, 1, 1, 1, 1)] > 0.9 > 0.1 > posterior["secret", (0, 0, 0, -1, 1)]
    assert set(pii.train(good, posterior)) == set(pii.KINDS) and pii.train({}, {})["email"]


def test_empty(spark, documents):
    assert pii.digest(pii.find(documents([]))).count() == 0
