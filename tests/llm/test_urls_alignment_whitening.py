import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odolith.llm import qd, token_alignment, url_rules, whitening

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PAGES = "page_id long, url string, html string, subject string, token string, rule string, verdict string, n int"
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "", "x", "y", "z", "w", 3) for i, u in urls], PAGES)


def fits(pattern, host, path):
    """The pattern language, read plainly."""
    body, subject = pattern.lstrip("|") if not pattern.startswith("||") else pattern[2:], host + path
    end = body.endswith("|")
    body = body[:-1] if end else body
    tail = "".join(".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|\Z)" if c == "^" else re.escape(c) for c in body) + (r"\Z" if end else "")
    if pattern.startswith("||"):
        starts = [0, *(i + 1 for i, c in enumerate(host) if c == ".")]
        return any(re.compile(tail, re.S).match(subject, i) for i in starts) or ("*" in body and re.match(r"(?:[^/]*\.)?" + tail, subject, re.S) is not None)
    return re.match(tail, subject, re.S) is not None if pattern.startswith("|") else re.search(tail, subject, re.S) is not None


ODD_URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://WWW.Example.NET/en/x"), (6, "http://example.net/EN/x"), (7, "http://net/"), (8, "http://net"), (9, "http://xnet/"), (10, "https://a.example.net/en/" + "y/" * 60_000),
    (11, "https://b.org/fr/?q=/de/"), (12, "https://example.com?/de/"), (13, "https://example.com#/de/"), (14, "https://example.com/de/#top"), (14, "https://example.com/de/#top"), (None, "https://m.ads-track.example.com/es/1"), (None, None), (15, "x://y://z.net/"),
    (16, "https://my-casino.example.com/a"), (17, "https://xads-track.example.com/"), (18, "https://a.example.com/adserver/1"), (19, "https://été.example.org/fr/ü"), (20, "https://a.org/frx"), (21, "https://a.doubleclick.example.com/"),
]


@pytest.mark.parametrize("broadcast_rules", [url_rules.BROADCAST_RULES, 0])
def test_url_rules_equal_brute_force(spark, broadcast_rules):
    urls = ODD_URLS + [(100 + i, f"https://h{i % 7}.example.net/{'en' if i % 3 else 'de'}/{i % 11}") for i in range(300)] + [(None, "https://hot.example.net/en/1")] * 200
    got = url_rules.judge(pages(spark, urls), url_rules.host_rules(spark, RULES), broadcast_rules=broadcast_rules).collect()
    expected = []
    for page_id, url in urls:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        listed = [(len(r), r, v) for v, r in RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        own = [(len(p), p) for p in url_rules.PATTERNS if fits(p, host, path)]
        best = (max(listed)[1], 0, max(listed)[2]) if listed else (max(own)[1], 1, "block") if own else (None, None, "allow")
        expected.append((page_id, host, path, *best))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.tier, r.verdict) for r in got) == Counter(expected)


def test_url_rules_run_on_candidates_only(spark):
    subjects = spark.createDataFrame([(f"h{i}.example.net/{'rare' if i == 5 else 'common'}/x", 1) for i in range(200)], "subject string, rows_of_key long")
    rules = spark.createDataFrame([("r1", "||example.net/rare/", "block", 0), ("r2", "||nowhere.example.net/", "block", 0), ("r3", "com*on/x|", "block", 0), ("r4", None, "block", 0)], url_rules.RULES)
    indexed = url_rules.index(url_rules.compiled(rules), subjects)
    assert {(r.rule, r.token, r.n) for r in indexed.collect()} == {("r1", "rare", 1), ("r3", "x", 200)}
    assert url_rules.candidates(subjects, indexed).count() == 201


def test_url_rules_without_rows_or_rules(spark):
    none = url_rules.host_rules(spark, [], ())
    assert [r.verdict for r in url_rules.judge(pages(spark, [(1, "http://a.net/")]), none, default="block").collect()] == ["block"]
    assert url_rules.judge(pages(spark, []), url_rules.host_rules(spark, RULES)).collect() == []


def plain_alignment(text):
    """Tokens, ends and links of one text by the libraries themselves."""
    import sentencepiece

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = token_alignment.byte_alphabet()
    if not text:
        return 0, 0, [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return 0, 0, [], []
    groups, links, at_a, at_b, i, j, fi, fj = [], [], 0, 0, 0, 0, 0, 0
    while i < len(ids_a):
        at_a, i = at_a + len(bytes_a[i]), i + 1
        while at_b < at_a:
            at_b, j = at_b + len(bytes_b[j]), j + 1
        if at_a == at_b:
            groups.append((ids_a[fi:i], ids_b[fj:j]))
            links.append((ids_a[i - 1], ids_b[j - 1]))
            fi, fj = i, j
    return len(ids_a), len(ids_b), groups, links


TEXTS = ["", None, "a", " a", "a ", "a  b", "x\n y", "\nx", "it's I'll 12,5", "a<|endoftext|>b </s> <unk> <0x41>", "héllo 日本͸ \U0001f600  x", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467 é́", "▁x", "a ▁ b", "tab\tb c", "\x00 \x1c x", "é" * 3000, "Ünïcödé Ω 漢字かな"]


def test_alignment_equals_brute_force(docs, odd_texts):
    rows = [*enumerate(TEXTS), *[(1000 + (i or 0), t) for i, t in odd_texts], (7, "the cat sat"), (7, "the cat sat"), (None, "the cat ran")]
    got = token_alignment.alignment(docs(rows), A, B).collect()
    plain = [(i, *plain_alignment(t)) for i, t in rows]
    counts = Counter(link for _, _, _, _, links in plain for link in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    expected = []
    for i, n_a, n_b, groups, links in plain:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        expected.append((i, n_a, n_b, len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(expected)
    assert token_alignment.alignment(docs([]), A, B).collect() == []


def test_coarse_ends_agree_with_decoded_bytes():
    tool = token_alignment.Aligner(A, B, cache_words=3)
    texts = [t for t in TEXTS if t and "▁" not in t]
    for ends in (tool.ends_a(texts), tool.ends_b(texts)):
        at = np.append(0, np.cumsum(ends.counts))
        for p, q in zip(at, at[1:]):
            assert ends.ends[p:q].tolist() == np.cumsum([len(s) for s in ends.spelled[p:q]]).tolist()
        assert ends.texts() == [f" {t}".encode() for t in texts]


def test_forgetting_words_changes_nothing():
    import pyarrow as pa

    texts = pa.array([" ".join(f"w{i * j % 41}" for i in range(30)) for j in range(20)])
    small, large = token_alignment.Aligner(A, B, cache_words=5), token_alignment.Aligner(A, B)
    for _ in range(3):
        assert small.align(texts)["groups"] == large.align(texts)["groups"]


VECTORS = "vec_id long, embedding array<float>, label int, x string, n int, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", 1, 2) for i, v in rows], VECTORS)


def checked(got, rows, d):
    """Compares with numpy on the distinct vectors; returns the number of components that vary."""
    f32 = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    x = {i: np.floor(256 * v).astype(np.int64) for i, v in f32.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9, abs_tol=1e-12)
    for c, rows_of in by.items():
        mine = np.array([rows_of[i].whitened for i in x])
        want = np.array([(x[i] - sums / n) @ u[:, c - 1] / math.sqrt(e[c - 1]) for i in x])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert max(r.identity_error for r in rows_of.values()) < 1e-9
    return len(by)


def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(5)
    scale = np.linspace(2, 0.2, 12)
    good = [(i, (rng.standard_normal(12) * scale + 3).tolist()) for i in range(700)]
    good += [(1000 + i, good[0][1]) for i in range(50)]  # copies weigh once
    bad = [(2000, None), (2001, [float("nan")] * 12), (2002, [None] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [1.0, 2.0]), (2005, [])]
    got = whitening.whitened(vectors(spark, good + bad).repartition(40), components=4).collect()
    assert len(got) == 750 * 4
    assert checked(got, good, 12) == 4


def test_whitening_edges(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, []), (2, None)])).collect() == []
    one = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(i, 1, 0, None, None, None) for i in (1, 1, None, None)]
    # fewer dimensions than components, one of which does not vary
    flat = whitening.whitened(vectors(spark, [(1, [1.0, 0.0]), (2, [-1.0, 0.0])])).collect()
    assert sorted((r.component, r.vec_id, r.whitened if r.whitened is None else abs(round(r.whitened, 9))) for r in flat if r.component == 1) == [(1, 1, 1.0), (1, 2, 1.0)]
    assert all(r.whitened is None for r in flat if r.component == 2)
    # equal eigenvalues: any directions, but the identity holds
    cross = [(k, [float(3 * s * (i == j)) for j in range(5)]) for k, (i, s) in enumerate((i, s) for i in range(5) for s in (1, -1))]
    assert max(r.identity_error for r in whitening.whitened(vectors(spark, cross)).collect()) < 1e-9
    # whole numbers beyond 64 bits: the deviation has no value
    huge = whitening.whitened(vectors(spark, [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 2.0])])).collect()
    assert any(r.deviation is None for r in huge) and all(r.n == 3 for r in huge)


@pytest.mark.parametrize("d, rows", [(1, 4), (2, 7), (24, 400), (24, 9), (40, 41)])
def test_qd_equals_svd(d, rows):
    rng = np.random.default_rng(d + rows)
    r = np.linalg.qr(np.vstack([rng.standard_normal((rows, d)) * rng.uniform(0.1, 9, d), np.zeros((d, d))]), mode="r")
    values, directions = qd.leading(r, 4)
    singular = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.sqrt(values), singular, rtol=1e-12, atol=1e-12 * singular[0])
    k = min(4, d, rows)
    assert np.allclose(directions[:k] @ directions[:k].T, np.eye(k), atol=1e-10)
    assert np.allclose(r.T @ (r @ directions[:k].T), directions[:k].T * values[:k], atol=1e-10 * values[0])


def test_dqds_keeps_small_values_accurate():
    # a graded bidiagonal matrix: the least singular values to full relative accuracy
    a, b = 10.0 ** -np.arange(0, 16, 2.0), np.array([10.0 ** -(k + 1) for k in np.arange(0, 14, 2.0)])
    got = np.sqrt(qd.squared_values(a, b))
    assert math.isclose(np.prod(got), np.prod(a), rel_tol=1e-12)
    assert np.all(np.diff(got) <= 0) and got[-1] > 0
