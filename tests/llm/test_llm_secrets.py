import hashlib
import re

from tessel.llm import secrets as S

SCHEMA = "doc_id long, text string, spans string, kind int"
TEXTS = [None, "", "no secret here", "PASSWORD = 'hunter22' and token: abc", "api_key=abcdef apikey:ABCDEF\"x", "secret: token: abcdefgh",
         "secre", "ſecret=abcdefg toKen=abcdefg", "AKIA" + "A" * 15, "xAKIA" + "A" * 16 + "z AKIAAKIA" + "B" * 14, "f" * 24 + "g" + "0" * 23,
         "é" * 5 + "deadbeef" * 4, "passwd\"  :  'a/b+c=d.e-f_g'", "-----BEGIN RSA PRIVATE KEY-----", "ftp://u:p@h",
         "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij", "Authorization: Bearer abcdefghijklmnopqrstu", "pas\nsword=abcdef"]


def brute(text, rules=S.BASE_RULES + S.ADDED_RULES):
    out = []
    for k, r in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "", r.flags) if r.keep is None or r.keep(m)]
    return sorted(out)


def test_same_spans_as_a_full_scan(spark):
    long = "lorem deed " * 20000 + "token=ZZZZZZ1" + " x" * 50000
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS + [long])] + [(3, TEXTS[3], "", 0), (None, "token=abcdef1", "", 0)]
    got = S.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _, _ in rows:
        all_ = brute(t)
        base = ",".join(f"{S.BASE_RULES[k].kind}:{s}:{e}" for s, k, e in all_ if k < 3)
        r = by[i]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == S.span_text(all_, S.BASE_RULES + S.ADDED_RULES)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in all_) for j in range(3))
    assert by[1].verified == 1  # an empty text: only the rule without trigrams
    assert S.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_queries_of_the_rules():
    q = {r.kind: S.trigram_query(r.pattern, r.flags) for r in S.BASE_RULES + S.ADDED_RULES}
    assert q["hex"] is None
    assert S.trigrams_of(q["access"]) == {b"aki", b"kia"} and q["access"][0] == "and"
    assert q["assign"][0] == "or" and {b"api", b"_ke", b"tok", b"ssw"} <= S.trigrams_of(q["assign"])
    assert S.trigram_query("a?bcd|x") is None
    assert S.trigram_query("(abc){2,}x*") == b"abc"


def test_every_match_is_a_candidate():
    index = S.TrigramIndex(set().union(*(S.trigrams_of(S.trigram_query(r.pattern, r.flags)) for r in S.BASE_RULES + S.ADDED_RULES)))
    texts = [t or "" for t in TEXTS]
    index.build([t.encode() for t in texts])
    for k, r in enumerate(S.BASE_RULES + S.ADDED_RULES):
        cand = set(index.candidates(S.trigram_query(r.pattern, r.flags)).tolist())
        assert {i for i, t in enumerate(texts) if any(x[1] == k for x in brute(t))} <= cand
