"""Each operator against a brute-force version or an exact round trip, and on odd tables."""

import hashlib
import itertools
import importlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import DATA, assert_same
from pyspark.sql import functions as F

from varve.llm import fingerprints, jpeg, kneser_ney, media, mixing, near_dedup, packing, queries, secret_scan, sharding, toxicity, warc
from varve.llm.components import connected_components
from varve.llm.text import distinct_by_row, mix, shingles, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())


# --- text


def test_sets_of_rows_without_an_order_of_all_rows(monkeypatch):
    """Sets are sorted a row at a time, and slots are filled without a temporary for each step."""
    monkeypatch.setattr(np, "lexsort", None)
    some = random.Random(5)
    for _ in range(50):
        rows = [[some.randrange(4) << 62 | some.randrange(3) for _ in range(some.randrange(6))] for _ in range(some.randrange(1, 6))]
        at = np.cumsum([0, *map(len, rows)])
        values, found = distinct_by_row(np.array(sum(rows, []), dtype=np.uint64), at)
        sets = [sorted(set(r)) for r in rows]
        assert [values[a:b].tolist() for a, b in zip(found, found[1:])] == sets
        slots = fingerprints.minhash(values, np.repeat(np.arange(len(sets)), np.diff(found)), len(sets), 8)
        odd, shift = (x.tolist() for x in fingerprints.permutations(8))
        assert slots.tolist() == [[min(((x * a + b) % (1 << 64) >> 32 for x in r), default=(1 << 64) - 1) for a, b in zip(odd, shift)] for r in sets]


def test_word_hashes_across_blocks(monkeypatch):
    import pyarrow as pa

    from varve.llm import text as module

    data = ["one Two  three", "", "four" * 30, "\tfive\x0bsix ", "é漢 one"]
    whole = word_hashes(pa.array(data))
    monkeypatch.setattr(module, "_BLOCK", 16)
    again = word_hashes(pa.array(data))
    assert (whole[0] == again[0]).all() and whole[1].tolist() == again[1].tolist() == [0, 3, 3, 4, 6, 8]
    assert whole[0][0] == whole[0][7]
    assert np.diff(shingles(*whole)[1]).tolist() == [1, 0, 1, 1, 1]


# --- op1


@pytest.mark.parametrize("kind", ["random", "zeros", "text", "small"])
def test_jpeg_round_trip(kind):
    r = np.random.default_rng(3)
    sizes = [64, 640, 64 * 37, 64 * 200]
    make = {"random": lambda n: r.integers(0, 256, n), "zeros": lambda n: np.where(r.random(n) < 0.93, 128, r.integers(0, 256, n)), "text": lambda n: r.integers(97, 123, n), "small": lambda n: r.integers(126, 131, n)}[kind]
    payloads = [make(n).astype(np.uint8) for n in sizes]
    decoder = jpeg.Decoder(b"".join(jpeg.encode(payloads)))
    for payload, frame, image in zip(payloads, decoder.frames, decoder.pixels()):
        assert ((decoder.blocks(frame) + 128).astype(np.uint8).ravel()[: len(payload)] == payload).all()
        assert image.shape == (frame.height, frame.width, 3)


def test_jpeg_pixels_against_direct_transform():
    payload = np.full(64 * 6, 128, np.uint8)
    payload[0] = 128 + 80  # DC of the first luma block
    payload[64 * 4 + 0] = 128 + 40  # DC of Cb
    decoder = jpeg.Decoder(jpeg.encode([payload])[0])
    image = decoder.pixels()[0]
    y, cb = 128 + 80 / 8, 40 / 8
    assert np.abs(image[:8, :8].astype(float) - [y, y - 0.344136 * cb, y + 1.772 * cb]).max() <= 1
    assert np.abs(image[8:, 8:].astype(float) - [128, 128 - 0.344136 * cb, 128 + 1.772 * cb]).max() <= 1


def test_frame_end_of_band_runs_and_no_restarts():
    """A hand-made grey image: one DC scan, one AC scan whose end-of-band run covers all blocks."""
    dc = [(2, 0), (2, 1), (2, 2)]
    ac = [(2, 0x20), (2, 0x00), (2, 0x01)]
    bits = "".join({0: "00", 2: "10"}[s] + extra for s, extra in [(2, "11"), (0, ""), (0, ""), (0, ""), (0, ""), (0, "")])
    pack = lambda b: int(b + "1" * (-len(b) % 8), 2).to_bytes((len(b) + 7) // 8, "big")
    head = bytes([0xFF, 0xD8]) + jpeg._segment(jpeg.DQT, bytes([0] + [1] * 64)) + jpeg._segment(jpeg.DHT, jpeg._dht(0, dc) + jpeg._dht(1, ac))
    head += jpeg._segment(jpeg.SOF2, bytes([8, 0, 16, 0, 24, 1, 1, 0x11, 0]))
    data = head + jpeg._segment(jpeg.SOS, bytes([1, 1, 0, 0, 0, 0])) + pack(bits)
    data += jpeg._segment(jpeg.SOS, bytes([1, 1, 0, 1, 63, 0])) + pack("00" + "10") + bytes([0xFF, 0xD9])
    decoder = jpeg.Decoder(data)
    assert decoder.coefficients[:, 0].tolist() == [3] * 6 and not decoder.coefficients[:, 1:].any()
    assert decoder.pixels()[0].shape == (16, 24, 1)


def test_media(odd, none, monkeypatch):
    rows = media.described(media.stored(odd)).collect()
    assert len(rows) == 10
    for row, doc in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.n_bytes)), sorted(odd.collect(), key=lambda r: (str(r.doc_id), len((r.text or "").encode())))):
        data = media.payload(doc.text or "")
        assert (row.payload_sha256, row.payload_bytes, row.tail_crc32) == (hashlib.sha256(data).hexdigest(), len(data), zlib.crc32(data[-64:]))
    assert media.described(media.stored(none)).count() == 0
    shown = media.tensors(media.stored(odd)).collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in shown)


def test_long_text_takes_several_frames(spark):
    text = "x" * (2 * media.FRAME_BYTES + 100)
    store = media.stored(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert media.described(store).first().payload_sha256 == hashlib.sha256(media.payload(text)).hexdigest()
    assert media.tensors(store).count() == 3


# --- op2


def components(sets, percent=75):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_of_documents(docs, texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    expected = components(sets)
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in expected.items()}


@pytest.mark.parametrize("signer", [near_dedup.superminhash, fingerprints.minhash])
def test_families_of_edited_copies(spark, signer):
    r = random.Random(5)
    rows, base = [], [f"w{r.randint(0, 10**6)}" for _ in range(150)]
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), signer=signer)
    assert {x.doc_id: x.component_id for x in got.collect()} == components({i: shingle_set(t) for i, t in rows})


def edited(words, r, n, fresh):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = fresh()
    return out


@pytest.mark.parametrize("limit", [4, 0])
def test_mixed_families_lose_no_link(spark, monkeypatch, limit):
    """Stragglers beside a hub, parts of it, a shared insertion, edits of edits; with and without further hubs."""
    monkeypatch.setattr(near_dedup, "PAIRS_A_ROW", limit)
    r, number = random.Random(9), itertools.count()
    fresh = lambda: f"f{next(number)}"
    base = [fresh() for _ in range(150)]
    rows = [base] + [edited(base, r, r.randint(1, 9), fresh) for _ in range(60)]
    inserted = [fresh() for _ in range(60)]
    rows += [edited(base[:70] + inserted + base[70:], r, r.randint(0, 6), fresh) for _ in range(40)]
    rows += [base[: r.randint(80, 149)] for _ in range(15)] + [base[r.randint(1, 70) :] for _ in range(15)]
    rows += [edited(x, r, r.randint(1, 3), fresh) for x in r.sample(rows, 40)]
    rows += [edited(base, r, 6, lambda: f"few{r.randint(0, 3)}") for _ in range(40)]
    texts = [(7 * i % 997, " ".join(x)) for i, x in enumerate(rows)]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {x.doc_id: x.component_id for x in got.collect()} == components({i: shingle_set(t) for i, t in texts})


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "uno dos tres cuatro cinco seis")
    rows = [(5, a), (5, b), (3, b), (9, a), (9, a), (4, c), (1, c), (4, "quatre cinq six sept huit neuf")]
    got = sorted((x.doc_id, x.component_id, x.kept) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(5, 5, True), (5, 3, False), (3, 3, True), (9, 5, False), (9, 5, False), (4, 1, False), (1, 1, True), (4, 4, True)])


def test_components_of_a_hub(spark, monkeypatch):
    from varve.llm import components as stars

    monkeypatch.setattr(stars, "LEAST_HOT", 4)
    edges = [(100, k) for k in range(200, 300)] + [(k, k + 1000) for k in range(200, 230)] + [(7, 1205), (50, 51)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {v for k, v in got.items() if k not in (50, 51)} == {7} and got[51] == 50 and len(got) == 134


def test_near_duplicates_of_odd_rows(odd, none):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert got[(0, 0)] == (0, True) and got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True)
    assert got[(4, 1)] == (4, True) and got[(5, 1)] == (4, False) and got[(None, 1)] == (None, True)
    assert near_dedup.near_duplicates(none).count() == 0


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(1)
    shared, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (300, 100, 100))
    e = np.concatenate([shared, a, shared, b])
    s = near_dedup.superminhash(e, np.repeat([0, 1], 400), 2, 192)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12
    assert not (s == np.iinfo(np.uint64).max).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)] + [(None, 3), (7, 7)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 150, 200)} | {i: 500 for i in range(500, 540)}


# --- op3


def test_warc(spark, sf):
    assert_same(queries.op3_warc_normaliser(spark, sf), warc.SQL, sf)


def test_warc_of_odd_pages(spark):
    x = "é" * 60
    pages = spark.createDataFrame([(1, "u\r\nv", None), (2, None, ""), (5, "b", x), (3, "a", x), (None, "n", x), (3, "a", x), (9, "s", "short"), (8, "s", "short"), (4, "http://x/ é", "\r\n\r\nWARC/1.1\r\n" * 20)], "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    got = sorted((tuple(r) for r in warc.archived(spark, pages).collect()), key=str)
    assert len(got) == 9
    by = {}
    for page, size, digest, kind, to in got:
        by.setdefault(page, []).append((size, digest, kind, to))
    d = hashlib.sha256(x.encode()).hexdigest()
    assert by[5] == [(120, d, "revisit", 3)] and by[None] == [(120, d, "revisit", 3)] and by[3] == [(120, d, "response", None)] * 2
    assert by[1][0][0] == by[2][0][0] == 0 and by[8][0][2] == by[9][0][2] == "response"
    assert warc.archived(spark, pages.where("false")).count() == 0


# --- op4


def base_spans(text):
    out = []
    for kind, pattern, group, least in (("assign", r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12), ("access", "(AKIA[A-Z0-9]+)", 1, 18), ("hex", "([0-9a-f]+)", 1, 16)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


PIECES = ["password", "SECRET", "Token", "api_key", "apikey", '"', "'", " ", "=", ":", "abcdef012345", "deadbeefdeadbeef", "AKIA", "ABCD1234EFGH5678", "x", "\n", "é", "/", "key"]


def test_base_secrets_against_plain_patterns(texts):
    r = random.Random(2)
    samples = list(texts.values()) + ["".join(r.choice(PIECES) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for text in samples:
        assert [(a, k, b) for a, k, b in secret_scan.scan(text) if k != "literal"] == [(a, kind, b) for a, _, b, kind in base_spans(text)], text


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('a = "Zx81kfQp9"\npassword = a', ["Zx81kfQp9"]),
        ('a = "Xy9z"; b = "81kQpw"\nsecret_key = a + b', ["Xy9z", "81kQpw"]),
        ('{"client_secret": "aB3$kd82Lm!q"}', ["aB3$kd82Lm!q"]),
        ("password: your_password", []),
        ("the token: is here and title = 'A story of 1984'", []),
        ("url = 'https://example.org/a1b2c3'", []),
    ],
)
def test_literals_reach_sensitive_names(text, found):
    assert [text[a:b] for a, b in secret_scan.literals(text)] == found


def test_long_chains_and_names_reach_sensitive_names():
    parts = [f"Zx{i}kQ" for i in range(12)]
    for text in (f"a = {' + '.join(map(repr, parts))}\npassword = a", "\n".join([f"a = '{parts[0]}'", *(f"a = a + '{p}'" for p in parts[1:]), "password = a"])):
        assert [text[a:b] for a, b in secret_scan.literals(text)] == parts
        assert not any(p in secret_scan.redact(text) for p in parts)
    for name in ("n" * 300, "$" + "ab_9." * 60 + "z"):
        text = f"{name} = 'Zx81kfQp9'\npassword = {name}"
        assert [text[a:b] for a, b in secret_scan.literals(text)] == ["Zx81kfQp9"]
    text = "a = 'Zx81kfQp9'\n" + "a = a + a\n" * 3000 + "password = a\n" + "x" * 300_000 + " a1-" * 50_000
    assert [text[a:b] for a, b in secret_scan.literals(text)] == ["Zx81kfQp9"]


def test_literals_inside_base_spans_by_plain_comparison():
    """Many hex runs and literals: what some base span holds is found by bisection as by comparing all."""
    r = random.Random(8)
    text = " ".join(r.choice(["password = '{}'", "x{} = 1", "{}", "secret_key: '{} {}'"]).format(*("%032x" % r.getrandbits(128) for _ in range(2))) for _ in range(400))
    base = [(a, b) for a, k, b in secret_scan.scan(text) if k != "literal"]
    expected = [(a, b) for a, b in secret_scan.literals(text) if not any(x <= a and b <= y for x, y in base)]
    assert sorted((a, b) for a, k, b in secret_scan.scan(text) if k == "literal") == expected and len(base) > 200


def test_secrets_of_odd_rows(odd, none):
    rows = secret_scan.secrets(odd).collect()
    assert len(rows) == 10 and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.secrets(none).count() == 0
    assert "abcdef0123456789" not in secret_scan.redact("x token = abcdef0123456789 y") and secret_scan.redact("plain") == "plain"


# --- op5


def test_kneser_ney_against_brute_force(docs, texts, monkeypatch):
    monkeypatch.setattr(kneser_ney, "PART_BYTES", 60_000)
    tokens = {i: WORD.findall(lowered(t)) + ["end "] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for i in train for w in tokens[i])
    total, size = sum(count.values()), len(count)
    pairs = Counter(p for i in train for p in zip(["start "] + tokens[i], tokens[i]))
    follows, after, kinds = Counter(b for _, b in pairs), Counter(), {}
    for (a, _), n in pairs.items():
        after[a] += n
        kinds.setdefault(a, [0, 0, 0])[min(n, 3) - 1] += 1
    of = lambda c: kneser_ney.discounts(*[Counter(c.values())[i] for i in range(1, 5)])
    d, u = of(pairs), of(follows)
    rest = sum(u[min(k, 3) - 1] for k in follows.values()) / len(pairs)
    low = lambda w: (max(follows[w] - u[min(follows[w], 3) - 1], 0) / len(pairs) if w in follows else 0) + rest / (size + 1)

    def high(w, v):
        if v not in after:
            return low(w)
        n = pairs[(v, w)]
        return (n - d[min(n, 3) - 1] if n else 0) / after[v] + sum(x * y for x, y in zip(d, kinds[v])) / after[v] * low(w)

    for r in kneser_ney.held_out_scores(docs).collect():
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (total + 0.1 * (size + 1))) for x in w))
        assert r.score == pytest.approx(sum(math.log10(high(b, a)) for a, b in zip(["start "] + w, w)))


def test_model_is_a_distribution_and_odd_rows(odd, none):
    rows = kneser_ney.held_out_scores(odd).collect()
    assert len(rows) == 10 and all(r.n_tokens >= 1 and r.score < 0 for r in rows)
    assert kneser_ney.held_out_scores(none).count() == 0
    nothing = kneser_ney.fit(none.select("text"))
    assert nothing.tokens == 0 and kneser_ney.scored(odd, nothing).count() == 10


def test_a_frequent_context_is_dealt_out(spark, monkeypatch):
    rows = [(i, " ".join(f"the x{i}y{k}" for k in range(400))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = {r.doc_id: r for r in kneser_ney.held_out_scores(docs).collect()}
    monkeypatch.setattr(kneser_ney, "PART_BYTES", 8_000)
    monkeypatch.setattr(kneser_ney, "TASK_PAIRS", 3_000)
    model = kneser_ney.fit(docs.select("text"))
    sizes = [len(found[0]) if (found := model.arrays()[1].part(i)) else 0 for i in range(model.parts)]
    assert model.hot.bits == 0 and len(repr(model.hot)) < 400
    monkeypatch.setattr(kneser_ney, "HOT_PARTS", 16)  # the same list in four files
    split = kneser_ney.fit(docs.select("text"))
    assert split.hot.bits == 2 and [len(split.arrays()[1].part(i)[0]) for i in range(64)] == sizes
    assert model.parts == 64 and sum(sizes) == model.pairs and max(sizes) <= 4 * sum(sizes) / model.parts
    for r in kneser_ney.held_out_scores(docs).collect():
        assert r[:5] == whole[r.doc_id][:5] and r.score == pytest.approx(whole[r.doc_id].score)


# --- op6


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprints.fingerprinted(docs).collect()}
    ids = sorted(texts)
    for i, n in zip(ids, ids[1:] + ids[:1]):
        cut = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - cut] + texts[n][:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        a, b = (np.frombuffer(bytes.fromhex(got[k].fingerprint), ">u2") for k in (i, n))
        assert got[i].near_next == pytest.approx((a == b).mean())
        x, y = shingle_set(texts[i]), shingle_set(edited)
        if len(x | y) > 50:
            assert abs(got[i].near_edited - len(x & y) / len(x | y)) < 0.25
    assert len(got) == len(ids)


def test_fingerprint_values_against_brute_force(texts):
    some = list(texts.values())[:12] + ["", "a b", "A b"]
    values, at = shingles(*word_hashes(pa.array(some)))
    odd, shift = (x.tolist() for x in fingerprints.permutations(fingerprints.SLOTS))
    top = 1 << 64
    scrambled = lambda least: int(mix(np.array([least], dtype=np.uint64))[0]) & 0xFFFF
    for i, got in enumerate(fingerprints.fingerprints(pa.array(some))):
        own = set(values[at[i] : at[i + 1]].tolist())
        least = [min(((x * a + b) % top >> 32 for x in own), default=top - 1) for a, b in zip(odd, shift)]
        assert got.tolist() == [scrambled(x) for x in least]


def test_minhash_groups_against_brute_force(spark, sf, texts):
    got = {r.doc_id: r.component_id for r in queries.minhash_groups(spark, sf).collect()}
    assert got == components({i: shingle_set(t) for i, t in texts.items()})


def test_fingerprints_of_odd_rows(spark, odd, none):
    assert fingerprints.fingerprinted(odd).count() == 10 and fingerprints.fingerprinted(none).count() == 0
    one = fingerprints.fingerprinted(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 15


# --- op7


def test_ranges_go_into_no_plan(spark, docs, texts, monkeypatch):
    """More ranges give the same rows by a plan of the same length."""
    few = fingerprints.fingerprinted(docs)
    monkeypatch.setattr(fingerprints, "TASK_BYTES", 4_000)
    many = fingerprints.fingerprinted(docs)
    plans = [len(df._jdf.queryExecution().executedPlan().toString()) for df in (few, many)]
    assert abs(plans[0] - plans[1]) < 200
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_fingerprints_of_a_frequent_id_and_null_ids(spark):
    rows = [(i, f"a b c d e {t} f g") for i, t in [(7, "x")] * 60 + [(7, "y")] * 5 + [(None, "z")] * 30 + [(9, "w")]]
    found = fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 96 and sum(r.near_next == 1.0 for r in found) >= 92


def test_lookup_table_by_turns():
    shards, m = ["a", "b", "c"], 13
    owner = sharding.lookup_table(shards, m)
    prefs = [[(sharding._number(f"offset {s}") % m + j * (sharding._number(f"skip {s}") % (m - 1) + 1)) % m for j in range(m)] for s in shards]
    expected, turn = {}, 0
    while len(expected) < m:
        slot = next(p for p in prefs[turn % 3] if p not in expected)
        expected[slot] = turn % 3
        turn += 1
    assert owner.tolist() == [expected[i] for i in range(m)]
    big, fewer = sharding.lookup_table([f"s{i}" for i in range(20)]), sharding.lookup_table([f"s{i}" for i in range(19)])
    assert np.ptp(np.bincount(big)) <= 1
    assert ((big != fewer) & (big != 19)).mean() < 0.1


def test_placement(odd, none):
    rows = sharding.placed(odd, "doc_id", ["x", "y"]).collect()
    owner = sharding.lookup_table(["x", "y"])
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, "xy"[owner[slot]])
    assert len(rows) == 10 and sharding.placed(none, "doc_id", ["x"]).count() == 0


# --- op8


def test_encoder_equals_the_tokenizer(texts):
    e = packing.Encoder(packing.default_tokenizer())
    odd = ["a\x1cb c", "İstanbul ΣΑΣ x", "e ́a", "don't <|endoftext|>x y.", "\x85 a\xa0b", "", "  ", "A.B. c!? d", "\x0b\x0c a\x00b", "It's. OK' , x;\n y's.", "3. 4, µ. ß. Ÿ."]
    r = random.Random(4)
    odd += ["".join(r.choice("aB'.,! \n9é漢́\xa0;ﬁ") for _ in range(40)) for _ in range(500)]
    for group in (odd, list(texts.values())[:60]):
        direct = [np.array(x.ids, dtype="<u4").tobytes() for x in e.tokenizer.encode_batch(group, add_special_tokens=False)]
        assert e.encode(group) == direct


@pytest.mark.parametrize("seed", range(6))
def test_pack_is_valid_and_close(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, [4097, 600, 2100, 30, 4097, 1400][seed], 2500)
    where, offset = packing.pack(lengths)
    fill = np.bincount(where, lengths)
    assert fill.max() <= 4096
    order = np.lexsort((offset, where))
    begins = np.r_[True, where[order][1:] != where[order][:-1]]
    assert (offset[order][begins] == 0).all()
    assert (offset[order][1:] == offset[order][:-1] + lengths[order][:-1])[~begins[1:]].all()
    small = lengths.max() < 1400
    assert fill.size <= -(-lengths.sum() // 4096) * (1.0 if small else 1.13) + 1


@pytest.mark.parametrize(
    ("bins", "after"),
    [
        ([[3], [6]], [[], [3, 6]]),  # a move
        ([[5], [2, 6]], [[2], [5, 6]]),  # one for one
        ([[5], [1, 2, 6]], [[1, 2], [5, 6]]),  # two for one
        ([[1], [5, 6]], [[1], [5, 6]]),  # nothing fits
    ],
)
def test_a_step_of_the_local_search(bins, after):
    found = packing.Bins(11)
    for _ in bins:
        found.items.append([])
        found.free.append(11)
        found.by_free[11].add(len(found.items) - 1)
        found.mask |= 1 << 11
    for b, lengths in enumerate(bins):
        for i, length in enumerate(lengths):
            found.put(b, (length, 10 * b + i))
    squares = sum((11 - f) ** 2 for f in found.free)
    moved = found.step(0)
    assert [[n for n, _ in own] for own in found.items] == after
    assert moved == (after != bins) and (not moved or sum((11 - f) ** 2 for f in found.free) > squares)


def test_a_move_into_an_emptier_bin_is_none():
    found = packing.Bins(12)
    for b, lengths in enumerate([[4, 5], [1]]):
        found.items.append([])
        found.free.append(12)
        found.by_free[12].add(b)
        found.mask |= 1 << 12
        for i, length in enumerate(lengths):
            found.put(b, (length, 10 * b + i))
    assert not found.step(0) and found.step(1) and sorted(map(len, found.items)) == [0, 3]


def test_packing_against_the_fewest_bins():
    """Small inputs against an exhaustive search."""

    def fewest(lengths, bins=()):
        if not lengths:
            return len(bins)
        first, rest = lengths[0], lengths[1:]
        fits = {b for b in bins if b >= first}
        tried = [fewest(rest, tuple(sorted((*(bins[: bins.index(b)] + bins[bins.index(b) + 1 :]), b - first)))) for b in fits]
        return min([*tried, fewest(rest, tuple(sorted((*bins, 20 - first))))])

    r = random.Random(5)
    more = 0
    for _ in range(40):
        lengths = sorted((r.randint(2, 14) for _ in range(8)), reverse=True)
        where, _ = packing.pack(np.array(lengths), 20)
        more += int(where.max() + 1 - fewest(lengths))
    assert more <= 1


def test_packed_rows(docs, texts, odd, none):
    got = packing.packed(docs, group_pieces=40).collect()
    tokens = packing.Encoder(packing.default_tokenizer())
    for i in list(texts)[:40]:
        data = tokens.encode([texts[i]])[0] + (1).to_bytes(4, "little")
        parts = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in parts] == [(a // 4, len(data[a : a + 16384]) // 4, zlib.crc32(data[a : a + 16384])) for a in range(0, len(data), 16384)]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.packed(odd).count() >= 10 and packing.packed(none).count() == 0
    assert packing.packed(odd, keep_ids=True).where("length(ids) <> 4 * length").count() == 0


# --- op9


def test_mixing(spark, sf):
    assert_same(queries.op9_source_mixing(spark, sf), mixing.SQL, sf)


def test_mixing_reaches_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 4 if i % 3 else 0}") for i in range(4000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("row.source", "size", "source_size", "target", "copies").collect()
    by = {}
    for r in plan:
        assert 0 <= r.copies <= 3
        by.setdefault((r.source, r.source_size, r.target), []).append(r.size * r.copies)
    total = sum(size for _, size, _ in by)
    assert sum(t for *_, t in by) == pytest.approx(total)
    for (source, size, target), taken in by.items():
        assert target <= 3 * size + 1e-6 and sum(taken) == pytest.approx(target, rel=0.01), source


def test_mixing_odd_rows(odd, none):
    assert mixing.mix_plan(odd).count() == 10 and mixing.mix_plan(none).count() == 0
    again = [sorted(map(str, mixing.mixed(odd).collect())) for _ in range(2)]
    assert again[0] == again[1] and mixing.mixed(odd).columns == odd.columns


# --- op10


def test_toxicity_on_planted_words(spark):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = []
    for i in range(900):
        w = prose(r.randint(30, 200)).split()
        if toxic := i % 6 == 0:
            for _ in range(max(2, len(w) // 40)):
                w.insert(r.randrange(len(w)), r.choice(["gribbox", "vukmalo", "zypquat"]))
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    right = [got[i].predicted == rows[i][2] for i in held]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= x.score <= 1 for x in got.values())


def test_ordinary_dictionary_sees_the_whole_sample(monkeypatch):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(10)) for _ in range(700)]
    model = toxicity.train(texts + ["vile zorgon text"] * 5, np.array([0] * 700 + [1] * 5))
    assert all(f" {w} ".encode() in model.ordinary for w in (texts[0].split()[-1], texts[-1].split()[0], texts[-1].split()[-1]))
    runs = ["zorgon", "vexquil", "brathmul", "krungvok", "plimtaz", "dwerrop"]
    found = [f" {' '.join(runs[:k])} {''.join(r.choice('abcdefgh') for _ in range(60))} ".encode() for k in (1, 2, 3, 4, 5, 6)]
    monkeypatch.setattr(toxicity, "ORDINARY_BYTES", 3 * len(found[-1]))
    model = toxicity.ToxicityModel(b"ordinary text of the sample ", " ".join(runs).encode(), np.zeros(1), np.zeros(0), np.ones(0))
    assert toxicity._with_hard_windows(model, found) == model.ordinary + found[-1]


def test_toxicity_against_a_model_in_memory(spark):
    """The query's scores are those of the plain way: lengths of each window by zstandard itself, thresholds and curve from unseen parts."""
    import zstandard

    r = random.Random(11)
    rows = []
    for i in range(240):
        w = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 6))) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join([*w, *(["Gribbox!", "zypquat"] * (i % 5 == 0))]), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {x.doc_id: x.score for x in toxicity.toxicity(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    order = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5)
    part = np.array([zlib.crc32(o.encode()) % 3 for o, _ in order])
    model = toxicity.train([rows[i][1] for _, i in order], np.array([rows[i][2] for _, i in order]), part)
    pack = lambda data, w: len(zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(w))
    for i, text, _ in rows[:40]:
        found = [x for x in (w.strip(".,;:!?") for w in text.lower().split()) if x]
        cut = [f" {' '.join(found[k : k + 16])} ".encode() for k in range(0, len(found), 16)]
        gain = np.array([pack(model.ordinary, w) - pack(model.toxic + model.ordinary, w) for w in cut])
        assert got[i] == pytest.approx(float(model.score(np.array([toxicity.features(gain, model.thresholds)]))[0]))


def test_toxicity_of_odd_rows(spark, odd, none):
    marks = spark.createDataFrame([(3, 0), (4, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, marks).count() == 10
    assert toxicity.toxicity(odd, marks.where("false")).where("score > 0.5").count() == 0
    assert toxicity.toxicity(none, marks).count() == 0


# --- registration


def test_queries_are_all_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


def test_pipeline_of_odd_rows(spark, sf, odd, none):
    import corpus_pipeline as pipeline

    docs = odd.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text"))
    for some, least in ((docs, 5), (docs.where("false"), 0)):
        for _, stage in pipeline.STAGES:
            some = stage(spark, some, sf)
            if _ == "near_dedup":
                kept = [(r.doc_id, r.text) for r in some.collect()]
                assert len(kept) == len(set(kept)) and len([k for k in kept if k[0] == 3]) == min(1, least)
        assert some.count() >= least


def test_near_dedup_stage_keeps_other_texts_of_an_id(spark, sf):
    import corpus_pipeline as pipeline

    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "uno dos tres cuatro cinco seis")
    rows = [(5, a, "x"), (5, b, "x"), (9, a, "y"), (4, c, "x"), (4, c, "x"), (4, c, "w"), (None, a, "x"), (6, "", "x"), (6, None, "x")]
    kept = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), sf)
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in spark.createDataFrame([(5, a, "x"), (5, b, "x"), (4, c, "w"), (None, a, "x"), (6, "", "x"), (6, None, "x")], kept.schema).collect())


def test_pipeline(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = pipeline.drop_toxic(spark, docs, sf)
    one = pipeline.drop_near_copies(spark, clean, sf)
    texts = {r.doc_id: r.text for r in clean.collect()}
    expected = components({i: shingle_set(t) for i, t in texts.items()})
    assert {r.doc_id for r in one.collect()} == {i for i, c in expected.items() if i == c}
    hidden = pipeline.hide_secrets(spark, one, sf)
    assert hidden.columns == docs.columns and hidden.count() == one.count()
    for r in hidden.collect():
        assert r.text == secret_scan.redact(texts[r.doc_id]) and r.n_chars == len(r.text)
    mixed = pipeline.mix(spark, hidden, sf)
    assert mixed.columns == docs.columns
    packed = pipeline.pack(spark, mixed, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert packed.where("piece = 0").count() == mixed.count()
    assert pipeline.run(spark, sf).count() == packed.count()
