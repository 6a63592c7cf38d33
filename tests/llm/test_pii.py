import hashlib
import random
import re
import time

from tessella.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0, "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_matches_the_patterns():
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("aB1.@ -+%é", k=rnd.randint(0, 40))) for _ in range(20000)]
    texts += ["".join(rnd.choices("0123456789012345 -.+()", k=rnd.randint(10, 60))) for _ in range(20000)]
    texts += ["a@b@c.d.e@f.g", "@a.b", "x@-.-", "1.2.3.4.5.6.7.8", "300.1.1.1.2", "00000000000001.2.3.4", "4111 1111 1111 1111", "+1 (017) 555-7713"]
    for t in texts:
        assert sorted(pii.scan(t), key=lambda s: (s[0], pii.KINDS.index(s[2]))) == brute(t), t
        base, found = pii.find(t)
        assert set(base) <= set(found)


def test_disguises():
    cases = {
        "write jane.doe [at] mail (dot) example [dot] com now": ("jane.doe [at] mail (dot) example [dot] com", "email"),
        "write jane at example dot com now": ("jane at example dot com", "email"),
        "write jane @ example . com now": ("jane @ example . com", "email"),
        "jаne@exаmple.com!": ("jаne@exаmple.com", "email"),
        "ja​ne@exam​ple.com": ("ja​ne@exam​ple.com", "email"),
        "call plus one two one two five five five oh one double nine please": ("plus one two one two five five five oh one double nine", "phone"),
        "ip one nine two dot 168 dot zero dot one.": ("one nine two dot 168 dot zero dot one", "ip"),
        "card four one one one 1111 1111 111 one": ("four one one one 1111 1111 111 one", "card"),
        "＋１ ２１２ ５５５ ０１９９": ("＋１ ２１２ ５５５ ０１９９", "phone"),
    }
    for t, (part, kind) in cases.items():
        assert (t.index(part), t.index(part) + len(part), kind) in pii.find(t)[1], (t, pii.find(t))
    for t in ["look at this. dot it", "one two three go", "we met at noon . then left", "meet at home.now ok", "un deux trois quatre", "a dot b at c"]:
        assert pii.find(t) == ([], []), (t, pii.find(t))


def test_disguises_that_leave_a_base_span():
    for part, kind in [("j\u043ehn.smith@example.com", "email"), ("user@mail.ex\u0430mple.com", "email"), ("+1 212 555 019\uff19", "phone"), ("+1 212 555 019 nine", "phone")]:
        t = f"write {part}, now"
        base, found = pii.find(t)
        assert (6, 6 + len(part), kind) in found and set(base) <= set(found), (t, found)
        assert pii.mask(t) == f"write <{kind}>, now"


def test_long_texts_take_linear_time():
    start = time.time()
    for t in ["a" * 10**6, "1" * 10**5 + "x", "1." * 10**5, "a@" * 10**5, "+1" + "(" * 10**5, "one " * 10**5, " at" * 10**5, "a.b " * 10**5, "é" * 10**5 + "а", "[ " * 10**5, "a" * 10**5 + " at b.com"]:
        pii.find(t)
    assert time.time() - start < 40


def test_report_and_mask(spark):
    rows = [(1, None), (2, ""), (3, "a@b.cd 1.2.3.4 a@b.cd"), (3, "x at y dot com"), (None, "é +1 (017) 555-7713 é")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    got = {(r.doc_id, r.spans): r for r in pii.report(df).collect()}
    assert len(got) == 5 and got[3, "email:0:6,ip:7:14,email:15:21"].n_email == 2
    assert got[3, "email:0:14"].base_sha256 == hashlib.sha256(b"").hexdigest() and got[3, "email:0:14"].n_email == 0
    assert [r.text for r in pii.masked(df).collect()] == [None, "", "<email> <ip> <email>", "<email>", "é <phone> é"]
    assert pii.masked(df).columns == df.columns and pii.report(df.limit(0)).count() == 0
