"""Hard negatives, vector codes and the secret scan against brute force, and on odd rows."""

import base64
import bz2
import gzip
import hashlib
import json
import lzma
import math
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from linkfield.llm import secret_scan
from linkfield.llm.hard_negatives import Best, Windows, fit_centres, highest, mine, walk
from linkfield.llm.secret_scan import scan, scan_secrets
from linkfield.llm.vector_codes import advanced, compress, length_of_lists, nearest_lists

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, dim, seed=3, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    around = rng.standard_normal((5, dim))
    x = around[rng.integers(0, 5, n)] + spread * rng.standard_normal((n, dim))
    return [(i, [float(c) for c in np.float32(v / np.linalg.norm(v))], int(rng.integers(0, labels))) for i, v in enumerate(x)]


def integers(vector):
    return np.floor(256 * np.array(vector, float)).astype(np.int64)


# 11 hard negatives


def negatives_of(rows, anchor):
    """rows: id, vector, label, each a row of its own."""
    rows = [(i, integers(v), lb) for i, v, lb in rows]
    out = []
    for a, (i, x, lb) in enumerate(rows):
        if not anchor(i):
            continue
        scored = sorted((-int(x @ y), j, r) for r, (j, y, _) in enumerate(rows) if r != a)
        for p, j, _ in [s for s in scored if rows[s[2]][2] == lb][:5]:
            fit = [(n, m) for n, m, r in scored if rows[r][2] != lb and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(i, j, k + 1, m, -p, -n) for k, (n, m) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("spread, options", [(1.0, {}), (0.3, {"bundle": 5, "block": 60, "members": 3}), (3.0, {"bundle": 2, "block": 1000, "members": 2})])
def test_hard_negatives(spark, spread, options):
    rows = vectors(400, 24, spread=spread)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = sorted(map(tuple, mine(df, F.col("vec_id") % 10 == 0, **options).collect()))
    assert got == negatives_of(rows, lambda i: i % 10 == 0) and got


def test_hard_negatives_of_odd_rows(spark):
    rows = vectors(60, 8, labels=2)
    copies = [rows[10], rows[10], (20, rows[10][1], 0), (61, rows[10][1], 1), (62, rows[10][1], 1), (63, [0.0] * 8, 0), (70, [1e30, -1e30] + [0.0] * 6, 1)]
    odd = [(64, None, 0), (65, rows[0][1], None), (66, [math.nan] * 8, 0), (67, [None] * 8, 0), (68, [math.inf] + [0.0] * 7, 1), (None, rows[10][1], 0)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows + copies + odd], VECTORS + ", score string, row int")
    held = [(i, [max(-16384.0, min(16384.0, c)) for c in v], lb) for i, v, lb in rows + copies]
    got = sorted(map(tuple, mine(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == negatives_of(held, lambda i: i % 10 == 0)
    assert mine(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0 and mine(df, F.col("vec_id") < 0).count() == 0
    one = df.where("label = 1 and vec_id < 20")
    assert mine(one, F.lit(True)).count() == 0  # no other label
    short = spark.createDataFrame([(0, [0.5, 0.5], 1), (1, [0.5], 1), (2, [0.5, 0.0, 0.0], 2), (3, [], 2)], VECTORS)
    assert sorted(map(tuple, mine(short, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 2, 128 * 128, 128 * 128)]


def test_walks_end_early_and_bounds_hold():
    x = np.array([integers(v) for _, v, _ in vectors(3000, 16, spread=0.2)])
    norm, labels = np.linalg.norm(x, axis=1), np.arange(3000) % 3
    centres = fit_centres(x[:200].astype(float), 5)
    angle = np.arccos(np.clip(x @ centres.T / norm[:, None], -1, 1))
    of = np.flatnonzero(angle.argmin(1) == 0)[:20]
    part = {"row": np.arange(3000), "vec_id": np.arange(3000), "label": labels, "norm": norm, "q": x}
    members = {k: v[of] for k, v in part.items()} | {"angle": angle[of, 0]}
    assert ((x[of] @ x.T) <= norm[of][:, None] * highest(norm, angle[:, 0], angle[of, 0].max()) + 1).all()
    states = [Best(5, -(1 << 62), None) for _ in of]
    assert walk(members, states, part, angle[:, 0], True) < 0.7 * 20 * 3000
    for i, s in zip(of, states):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(3000) if j != i and labels[j] == labels[i])[:5]
        assert [(-a, b) for a, b in zip(s.score, s.ids)] == want
    huge = {k: v for k, v in part.items()} | {"q": x << 20, "norm": norm * 2.0**20}  # beyond what doubles hold exactly
    state = Windows(5, 0, [(0, 1 << 60)])
    walk({k: v[:1] for k, v in huge.items()} | {"angle": angle[:1, 0]}, [state], huge, angle[:, 0], False)
    best = sorted((-(int(x[0] @ x[j]) << 40), j) for j in range(3000) if labels[j] != labels[0])
    assert [(-a, b) for a, b in zip(state.score, state.ids)] == [b for b in best if b[0] >= -(1 << 60)][:5]


# 12 vector codes


def codes_of(rows, parts, entries, rounds):
    rows = sorted(((i is None, i or 0, integers(v).tolist(), lb) for i, v, lb in rows), key=lambda r: r[:3])
    x = np.array([r[2] for r in rows]).reshape(len(rows), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(-1)
        near = d.argmin(2)
        for p, e in {(p, e) for p in range(parts) for e in near[:, p].tolist()} if r < rounds else ():
            own = x[near[:, p] == e, p]
            book[p, e] = own.sum(0) // len(own)
    error, by = d.min(2).sum(1), {}
    for (_, _, _, lb), n in zip(rows, error):
        by[lb] = by.get(lb, 0) + int(n)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return sorted(((None if m else i, "".join(f"{c:02x}" for c in near[k]), int(error[k]), by[lb], digest) for k, (m, i, _, lb) in enumerate(rows)), key=str)


@pytest.mark.parametrize("n, parts, entries, rounds, spread", [(700, 4, 16, 2, 1.0), (300, 2, 32, 6, 0.1), (40, 4, 64, 2, 1.0), (500, 8, 3, 4, 0.5), (60, 2, 1, 2, 1.0)])
def test_vector_codes(spark, n, parts, entries, rounds, spread):
    rows = vectors(n, 16, spread=spread)
    got = compress(spark.createDataFrame(rows, VECTORS).repartition(6), parts=parts, entries=entries, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=str) == codes_of(rows, parts, entries, rounds)


def test_vector_codes_of_odd_rows(spark):
    rows = vectors(50, 16)
    rows = [*rows, rows[3], (3, rows[4][1], None), (None, rows[5][1], None), (None, rows[6][1], 2), *[(100 + i, rows[7][1], 1) for i in range(40)]]
    odd = [(60, None, 0), (61, [math.nan] * 16, 0), (62, [None] * 16, 1), (63, [-math.inf] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows + odd], VECTORS + ", code string, error int")
    assert sorted(map(tuple, compress(df, entries=20).collect()), key=str) == codes_of(rows, 16, 20, 2)
    assert compress(df.where("false")).count() == 0 and compress(df.where("embedding is null")).count() == 0
    short = spark.createDataFrame([(0, [1.0], 1), (1, [], 1), (2, [0.5] * 18, 2), (3, [1e30] * 3, None)], VECTORS)
    padded = [(0, [1.0] + [0.0] * 31, 1), (1, [0.0] * 32, 1), (2, [0.5] * 18 + [0.0] * 14, 2), (3, [16384.0] * 3 + [0.0] * 29, None)]
    assert sorted(map(tuple, compress(short).collect()), key=str) == codes_of(padded, 16, 64, 2)


def test_bounds_certify_what_was_not_measured():
    rng = np.random.default_rng(8)
    q, book = rng.integers(-40, 40, (4000, 4)), rng.integers(-40, 40, (1, 32, 4))
    near, low, _ = nearest_lists(q, book[0], 8)
    part, measured = np.zeros(4000, np.int64), 0
    for step in range(8):
        new = book + rng.integers(-2, 3, book.shape) // (1 + step)
        moved = np.sqrt(((new - book) ** 2).sum(-1)) * (1 + 1e-12)
        near, low, walked, error = advanced(q, part, near, low, new, moved, 8 if step < 4 else 5 + step % 3)
        book = new
        exact = ((q[:, None, :] - book[0][None]) ** 2).sum(-1)
        assert (near[:, 0] == exact.argmin(1)).all() and (error == exact.min(1)).all()
        measured += int((walked != 255).sum())
    assert measured > 8000


def test_lists_adapt():
    walks = np.zeros(256, np.int64)
    walks[[1, 255]] = 50, 50
    assert length_of_lists(walks, 16, 64) == 32
    walks[[1, 2, 255]] = 900, 99, 1
    assert length_of_lists(walks, 16, 64) == 8 and length_of_lists(walks, 16, 16) == 3
    walks[:] = 0
    assert length_of_lists(walks, 16, 64) == 16


# 13 secrets

KEY = "AKIA" + "Q7" * 9
HEX = "0123456789abcdef" * 2


def spans(text):
    return [(secret_scan.KINDS[k], text[a:b]) for a, k, b in scan(text)[1]]


def base_of(text):
    """The base rules, word for word."""
    out = []
    for kind, pattern, group, least in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_rules(spark):
    draw = random.Random(4)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "AKIAAKIA", "ABCDEF0123456789XY", "deadbeef", "0123456789abcdef", "x.y-z/w+", "é", "\n", "ſecret", "toKen", "abcdefghijklm"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(1500)]
    rows = [(i, t) for i, t in enumerate([*texts, "", None, f"x{KEY}", None])]
    got = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = base_of(t or "")
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(base.count(k) for k in ("assign", "access", "hex"))
        assert set(filter(None, base.split(","))) <= set(filter(None, got[i].spans.split(",")))


def packed(text):
    return [gzip.compress(text), zlib.compress(text), bz2.compress(text), lzma.compress(text), zstandard.compress(text), gzip.compress(zlib.compress(text))]


def test_layers():
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    inner = f"my key is {KEY}, keep it"
    for coded in (b64(inner), base64.urlsafe_b64encode(inner.encode()).decode().rstrip("="), b64(b64(inner)), *map(b64, packed(inner.encode())), b64(b64(gzip.compress(b64(quote(inner)).encode())))):
        text = f"über {coded} end"
        assert spans(text) == [("access", coded)], coded
        assert not scan(f"über {b64('nothing to see in here, really')} end")[1]
    escaped = "".join(f"\\u{ord(c):04x}" for c in KEY)
    assert spans(f"a {escaped} b") == [("access", escaped)]
    assert spans("a " + "".join(f"&#{ord(c)};" for c in KEY)) == [("access", "".join(f"&#{ord(c)};" for c in KEY))]
    every = "".join(f"%{ord(c):02X}" for c in KEY)
    assert spans(f"a {every} b") == [("access", every)] and spans(f"a {every.replace('%', '%2525')} b") == [("access", every.replace("%", "%2525"))]
    assert spans("pass%77ord%3Dabcdefghijkl end") == [("assign", "pass%77ord%3Dabcdefghijkl")]
    assert spans(f"token: {b64('plain-secret-value')}") == [("assign", f"token: {b64('plain-secret-value')}")]
    lines = "\n".join(re.findall(".{1,76}", b64("x" * 100 + " " + KEY + " " + "y" * 100)))
    assert spans(f"a\n{lines}\nb") == [("access", lines)]
    path = f"data/v1/{b64(inner).rstrip('=')}"
    assert ("access", b64(inner).rstrip("=")) in spans(path) or ("access", path) in spans(path)
    quoted = json.dumps({"t": f"password={HEX}"}).replace("p", "\\u0070")
    assert ("hex", HEX) in spans(quoted) and any(k == "assign" for k, _ in spans(quoted))


def test_places_in_several_layers():
    mixed = f"ä%41 {HEX} \\u0041KIA{'Z9' * 8} {HEX}"
    assert [(k, t) for k, t in spans(mixed)] == [("hex", HEX), ("access", f"\\u0041KIA{'Z9' * 8}"), ("hex", HEX)]
    assert spans("%ff%fe" + "%41KIA" + "B" * 16) == [("access", "%41KIA" + "B" * 16)]
    assert scan("\\ud83d\\ude00 \\ud800 &amp;amp; %zz")[2] >= 2


def test_no_layer_is_taken_twice(monkeypatch):
    turns = {"a": "b", "b": "c", "c": "a"}
    monkeypatch.setattr(secret_scan, "DECODERS", (lambda layer, _: [(0, 1, turns[layer.text[0]])],))
    assert scan("a" + HEX)[2] == 3
    monkeypatch.undo()
    monkeypatch.setattr(secret_scan, "UNPACKED", 1000)
    bomb = base64.b64encode(gzip.compress(b"z" * 10000)).decode()
    assert scan(f"{bomb} {HEX}")[1:] == ([(len(bomb) + 1, 2, len(bomb) + 33)], 1, 1)


def test_secrets_of_odd_rows(spark):
    rows = [(1, None, "m"), (1, "", "m"), (None, f"{KEY} " * 3, "m"), (2, "word " * 400_000 + KEY, "m"), (2, "word " * 400_000 + KEY, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, r.n_access, r.spans) for r in scan_secrets(df).collect()), key=str)
    long = (2, 1, "access:2000000:2000022")
    assert got == [(1, 0, ""), (1, 0, ""), long, long, (None, 3, "access:0:22,access:23:45,access:46:68")]
    assert scan_secrets(df.where("false")).count() == 0
