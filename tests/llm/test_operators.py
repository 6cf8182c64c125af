"""The corpus operators against brute force, and on awkward rows."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import decontaminate as dec
from parlance.llm import language_id as lid
from parlance.llm import matroska as mk
from parlance.llm import pieces as pc
from parlance.llm import pii, secret_scan, sharding, simhash, warc
from parlance.llm import substring_dedup as sub
from parlance.llm.common import slices, utf8

from .corpus import AWKWARD, DOCS, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents() + AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """With extra columns that have the names operators use."""
    names = ("fp", "component_id", "n_words", "items", "size", "shard", "slot", "ids", "score", "anchors", "dk", "ord", "variant", "media", "root", "digest", "w", "_h", "_l")
    return df.select("*", *[F.lit(-7).alias(n) for n in names])


# decontamination

ITEMS = [(1, "w1x w2x w3x w4x w5x w6x w7x w8x w9x w10x w11x w12x"), (2, "Short item"), (3, None), (4, "!!!"), (10, "short ITEM"), (None, "an item without id")]
TEXTS = [(0, "so W2X, w3x w4x w5x w6x w7x w8x w9x w10x w11x and"), (1, "a short-item here; short item"), (2, "w1x w2x w3x"), (3, None), (4, "an item without id, that is")]


def brute_contamination(text, items, n=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, ids = find(text), set(), set()
    for item, t in items:
        g = find(t)
        k = min(n, len(g))
        grams = {tuple(g[i : i + k]) for i in range(len(g) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                ids |= {item} - {None}
    return len(w), len(hit), sorted(ids)


@pytest.fixture(params=[None, 0], ids=["broadcast", "join"])
def most(request):
    return dec.MAX_BROADCAST_BYTES if request.param is None else request.param


def many_texts(rng, n):
    """Random texts over few words, items among them in whole and in part, with repeated and missing keys."""
    out = list(TEXTS) + [(1, "a short-item here; short item"), (1, "clean"), (None, "short item"), (None, "clean"), (9, "w1x " * 30)]
    source = [w for _, t in ITEMS if t for w in t.split()] + ["Short", "item,", "é", "-", "漢字"]
    for i in range(n):
        out.append((rng.choice([None, i, i % 7]), " ".join(rng.choice([ITEMS[0][1], "short item", *source]) for _ in range(rng.randrange(12)))))
    return out


def test_contamination_equals_brute_force(spark, most):
    texts = many_texts(random.Random(31), 80)
    items = ITEMS + [(20, texts[-1][1]), (21, "w3x w4x"), (21, "w5x")]
    got = dec.contamination(clashing(spark.createDataFrame(texts, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"), most=most).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter((i, w, h, tuple(ids)) for i, t in texts for w, h, ids in [brute_contamination(t, items)])


def test_contamination_lists_string_ids(spark, most):
    items = spark.createDataFrame([(f"item {i}", t) for i, t in ITEMS], "item_id string, text string")
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in dec.contamination(texts, items, most=most).collect()}
    assert got == {0: ["item 1"], 1: ["item 10", "item 2"], 2: [], 3: [], 4: ["item None"]}


def test_decontaminate_removes_spans_or_documents(spark, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = many_texts(random.Random(32), 30)
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS))
    kept = dec.decontaminate(docs, items, most=most)
    clean = Counter((i, t) for i, t in texts if brute_contamination(t, ITEMS)[1] == 0)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == clean and kept.columns == docs.columns
    cut = dec.decontaminate(docs, items, remove="spans", most=most)
    assert cut.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in cut.collect())
    assert sum(rows.values()) == len(texts) and all(rows[k] >= n for k, n in clean.items())
    assert rows[0, "so  and"] and rows[1, "a  here; "] == 2 and rows[3, None]


def test_contamination_on_awkward_and_empty(spark, docs, empty, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dec.contamination(clashing(docs), items, most=most).count() == docs.count()
    assert dec.contamination(empty, items, most=most).count() == 0 and dec.decontaminate(empty, items, most=most).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.contamination(docs, none, most=most - 1).agg(F.sum("n_hit")).first()[0] == 0
    assert dec.decontaminate(docs, none, most=most - 1).count() == docs.count()


def test_ngram_set_is_as_small_as_its_bound_says():
    import pickle

    rng = random.Random(33)
    items = [(str(i), " ".join(f"w{rng.randrange(10**5)}x" for _ in range(500))) for i in range(300)]
    size = len(pickle.dumps(dec.NgramSet(items, dec.N)))
    assert size <= sum(len(t) for _, t in items) + 150_000 * dec.WORD_BYTES


# sharding


def test_sharding_law_and_places(spark, docs):
    rows = sharding.shard(clashing(docs), shards=5, slots=64).collect()
    source = docs.collect()
    assert len(rows) == len(source)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(5))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    raw = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in source)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == raw


def test_sharding_sizes_near_equal_and_versions(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(3000)], "doc_id long, text string")
    recs = sharding.records(docs, slots=512)
    first = sharding.plan_map(sharding.slot_sizes(recs), 7)
    loads = [r[0] for r in first.groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert len(loads) == 7 and max(loads) - min(loads) <= 0.02 * max(loads)
    path = sharding.shared_folder(spark, "map")
    sharding.store_map(first, path)
    second = sharding.rebalance(sharding.load_map(spark, path), 8)
    sharding.store_map(second, path)
    a = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    b = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert a.keys() == b.keys() and set(b.values()) == set(range(8))
    moved = sum(a[s] != b[s] for s in a)
    assert 0 < moved <= len(a) / 6 and all(b[s] == 7 for s in a if a[s] != b[s])
    loads = [r[0] for r in second.groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert max(loads) <= 1.3 * min(loads)


def test_sharding_spreads_rows_without_a_key_and_grows(spark):
    docs = spark.createDataFrame([(None, "the same text") for _ in range(3000)] + [(i, "x" * (i % 50)) for i in range(500)], "doc_id long, text string")
    rows = sharding.shard(docs, shards=6, slots=256, grow_to=7).collect()
    assert len(rows) == 3500 and {r.map_version for r in rows} == {1}
    slots = Counter(r.virtual_slot for r in rows if r.doc_id is None)
    assert len(slots) > 200 and max(slots.values()) < 40
    moved = [r for r in rows if r.next_shard != r.shard]
    assert moved and {r.next_shard for r in moved} == {6} and len(moved) < 3500 / 4
    assert len({(r.virtual_slot, r.next_shard) for r in rows}) == len({r.virtual_slot for r in rows})


def test_sharding_spreads_a_hot_key(spark):
    docs = spark.createDataFrame([(7 if i % 3 == 0 else i, "the same text" if i % 3 == 0 else "x" * (i % 50)) for i in range(6000)], "doc_id long, text string")
    rows = sharding.shard(docs, shards=6, slots=256, grow_to=7).collect()
    assert len(rows) == 6000
    slots, loads = Counter(r.virtual_slot for r in rows), Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert max(slots.values()) < 100 and max(loads.values()) < 1.05 * min(loads.values())
    once = {r.doc_id: r.virtual_slot for r in rows if r.doc_id != 7}
    again = {r.doc_id: r.virtual_slot for r in sharding.records(docs.filter("doc_id <> 7"), slots=256).collect()}
    assert once == again  # other keys alone decide


def brute_sharding(rows, shards, slots):
    """(id, size, checksum) and the shard of each record with a key, largest slot first; keys are unique."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    ids = spark.createDataFrame([(i,) for i, _ in rows], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(slots)).alias("s")).collect()
    slot = {r.i: r.s for r in ids}
    size = {i: len((t or "").encode()) + 8 for i, t in rows}
    total = Counter()
    for i, _ in rows:
        total[slot[i]] += size[i]
    load, to = [0] * shards, {}
    for s in sorted(total, key=lambda s: (-total[s], s)):
        to[s] = load.index(min(load))
        load[to[s]] += total[s]
    out, place = {}, Counter()
    for i, t in sorted(rows, key=lambda r: (slot[r[0]], r[0])):
        at = to[slot[i]]
        out[i] = (size[i], zlib.crc32((t or "").encode()), at, place[at])
        place[at] += 1
    return out


def test_sharding_query_equals_brute_force(spark, tmp_path):
    from parlance.llm.queries import op2_sharding

    rng = random.Random(17)
    rows = [(i * 3, rng.choice([None, "", "é" * rng.randrange(99), words_of(rng, rng.randrange(60))])) for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in op2_sharding(spark, str(tmp_path)).collect()}
    assert got == brute_sharding(rows, sharding.SHARDS, sharding.SLOTS)


def words_of(rng, n):
    return " ".join(f"w{rng.randrange(100)}" for _ in range(n))


def test_sharding_empty(empty):
    assert sharding.shard(empty).count() == 0 and sharding.shard(empty, grow_to=25).count() == 0


# personal data


def brute_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_equals_the_plain_expressions():
    rng = random.Random(1)
    parts = ["a@b.co", "x.y@z", "@", ".", "-", "1", "255", "256", "0000255", "1.2.3.4", "4111 1111 1111 1111", "+49 30 (123) 4567", "+", " ", "é", "a", "%", "4111-1111-1111-1111", "q@w.e@r.t", "\n", ","]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == brute_pii(text), text


def test_pii_validators_and_context():
    iban = "Konto: DE89 3704 0044 0532 0130 00"
    assert ("iban", 7, 34) in pii.find(iban) and pii.find(iban.replace("00", "01")) == []
    assert pii.score(iban, "iban", 7, 34) > pii.SCORES["iban"]
    assert pii.redacted("mail a@b.co or 1.2.3.4", 0.5) == "mail [EMAIL] or [IP]"
    assert pii.redacted("1.2.3.4", 0.9) == "1.2.3.4"
    assert pii.find("9" * 50000 + ".1.2.3") == []  # long runs stay cheap
    assert pii.find("a" * 100000) == []


@pytest.mark.parametrize("after", ["", " 10 EUR", " BIC COBADEFF", " I agree", " A", ". NEXT", " 1 2 3 4 5 6 7 8 9 0 1 2", " then"])
@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"])
def test_pii_ibans_before_words_and_numbers(iban, after):
    for before in ("", "pay AB12 ", "XX00 "):
        text = before + iban + after
        assert ("iban", len(before), len(before) + len(iban)) in pii.find(text)
        assert pii.redacted(text + " and " + iban, 0.5).count("[IBAN]") == 2
    assert not [s for s in pii.find(iban[:-1] + ("0" if iban[-1] != "0" else "1") + after) if s[0] == "iban"]
    assert not [s for s in pii.find(iban + "X") if s[0] == "iban"]


def test_pii_context_decides_and_scores_are_returned(spark, tmp_path):
    plain = "ZZ{:02d}370400440532013000"
    number = next(n for i in range(2, 99) if pii.mod97(n := plain.format(i)))
    assert pii.redacted(f"see {number} now", 0.5) == f"see {number} now"
    assert pii.redacted(f"account {number} now", 0.5) == "account [IBAN] now"
    assert pii.redacted("see DE89370400440532013000 now", 0.5) == "see [IBAN] now"
    from parlance.llm.queries import op3_pii

    rows = [(1, "server 1.2.3.4 and a@b.co"), (2, "1.2.3.4"), (3, None), (4, f"see {number}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.spans, r.scores) for r in op3_pii(spark, str(tmp_path)).collect()}
    assert got == {1: ("email:19:25,ip:7:14", "0.80,0.70"), 2: ("ip:0:7", "0.50"), 3: ("", ""), 4: ("iban:4:26", "0.40")}


def brute_ibans(text):
    """Numbers of known countries, by every start and the length of the country."""
    out, at = [], 0
    alnum = lambda c: c.isascii() and c.isalnum()
    for i in range(len(text)):
        n = pii._IBAN_LENGTH.get(text[i : i + 2])
        if i < at or n is None or (i and alnum(text[i - 1])) or not re.fullmatch("[0-9]{2}", text[i + 2 : i + 4]):
            continue
        end, taken = i, ""
        while len(taken) < n and end < len(text):
            c = text[end]
            if c == " " and len(taken) >= 4 and text[end - 1] != " ":
                end += 1
            elif c.isascii() and (c.isdigit() or c.isupper()):
                taken, end = taken + c, end + 1
            else:
                break
        if len(taken) == n and not (end < len(text) and alnum(text[end])) and int("".join(str(int(c, 36)) for c in taken[4:] + taken[:4])) % 97 == 1:
            out.append((i, end))
            at = end
    return out


def test_pii_ibans_equal_brute_force():
    rng = random.Random(18)

    def number(country):
        body = "".join(rng.choice("0123456789") for _ in range(pii._IBAN_LENGTH[country] - 4))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        raw = f"{country}{check:02d}{body}"
        return " ".join(raw[i : i + 4] for i in range(0, len(raw), 4)) if rng.random() < 0.5 else raw

    parts = [" ", ", ", "DE", "12", "A", "AB12", "x", "NO93", "é", "XX11", "0000", "GB82 WEST "]
    found = 0
    for _ in range(3000):
        each = [number(rng.choice(["DE", "NO", "GB", "MT", "FR"])) if rng.random() < 0.5 else rng.choice(parts) for _ in range(rng.randrange(9))]
        text = "".join(x + rng.choice(["", " ", ", "]) for x in each)
        known = [s for s in pii._ibans(text) if text[s[0] : s[0] + 2] in pii._IBAN_LENGTH]
        assert known == brute_ibans(text), text
        found += len(known)
    assert found > 500


def test_pii_on_awkward(docs, empty):
    out = pii.redact(clashing(docs))
    assert out.count() == docs.count() and out.filter("text is null").count() == 1
    assert docs.select(pii.spans(F.col("text")).alias("s")).count() == docs.count()
    assert pii.redact(empty).count() == 0


# secrets


def brute_secrets(text):
    a = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in a.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets_equal_the_plain_expressions():
    rng = random.Random(2)
    parts = ["Password", "api_key", "APIKEY", "toKen", "token", "secret", "=", ": ", '"', "'", "abc12345", "AKIA", "AKIA0123456789AB", "0123456789abcdef" * 2, "f", " ", "é", "/", "passwd='", "deadbeef" * 5]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert [s for s in secret_scan.find(text) if s[0] in secret_scan.BASE] == brute_secrets(text), text


def test_secrets_under_layers():
    import base64
    import gzip

    plain = 'token = "abcdefgh12345678"'
    once = base64.b64encode(plain.encode()).decode()
    twice = base64.b64encode(once.encode()).decode()
    packed = base64.b64encode(gzip.compress(plain.encode())).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in plain)
    url = "".join(f"%{ord(c):02X}" for c in once)
    for code, kind in ((once, "base64.assign"), (twice, "base64.assign"), (packed, "zip.assign"), (escaped, "unicode.assign"), (url, "url.assign")):
        text = f"see {code} there"
        assert (kind, 4, 4 + len(code)) in secret_scan.find(text), kind
    assert secret_scan.find("%25%32%35%25") == []


def test_secrets_escaped_in_part_wrapped_and_packed_twice():
    import base64
    import gzip

    plain = 'token = "abcdefgh12345678"'
    b64 = lambda raw: base64.b64encode(raw).decode()
    rng = random.Random(12)
    noise = "".join(rng.choice("abcdefghijklmnop qrstuv") for _ in range(600))
    packed = gzip.compress(f"{noise} {plain} {noise}".encode())
    members = gzip.compress(b"first") + gzip.compress(plain.encode())
    for raw in (gzip.compress(packed), members, gzip.compress(members), zlib.compress(packed), b64(packed).encode(), base64.encodebytes(packed)):
        code = b64(raw)
        assert any(s[0].endswith(".assign") and s[1:] == (4, 4 + len(code)) for s in secret_scan.find(f"see {code} there"))
    for code, kind in (("token\\u003dABCDEFGH12345678", "unicode.assign"), ("pass\\u0077ord: hunter2hunter2", "unicode.assign"), ("\\u0022token\\u0022: \\u0022ABCDEFGH12345678", "unicode.assign"), ("pass%77ord: hunter2hunter2", "url.assign"), ("AKIA\\u0030123456789ABC", "unicode.access")):
        start = code.startswith("\\u0022") * 6
        text = f"{{see {code} there \\ud800 \\u00e9 %FF"
        assert (kind, 5 + start, 5 + len(code)) in secret_scan.find(text), code
        assert any(s[0] == "zip." + kind.split(".")[1] for s in secret_scan.find(b64(gzip.compress(text.encode()))))
    for width in (20, 64, 76):
        for end in ("\n", "\r\n", "\n    "):
            code = b64(packed)
            lines = end.join(code[i : i + width] for i in range(0, len(code), width))
            for before in ("see: ", "a line\n", "word\n", "word of text\nabcdefghijklmnopqrstuvw\n"):
                for after in ("", "\nNext line", " end"):
                    got = [s for s in secret_scan.find(before + lines + after) if s[0] == "zip.assign"]
                    assert any(s[1] == len(before) and len(before + lines) <= s[2] <= len(before + lines + after) for s in got), (width, end, before, after)
    for raw in (packed, zlib.compress(packed)):
        for code, kind in (("".join(f"%{c:02X}" for c in raw), "url.assign"), ("".join(f"\\u{c:04x}" for c in raw), "unicode.assign")):
            assert (kind, 4, 4 + len(code)) in secret_scan.find(f"see {code} there"), kind
    assert secret_scan.find("word\n" * 20000) == []


def test_secrets_deep_in_large_compressed_layers():
    import base64
    import gzip

    plain = 'token = "abcdefgh12345678"'
    code = lambda raw: base64.b64encode(gzip.compress(raw)).decode()
    once = base64.b64encode(plain.encode()).decode()
    for filler in ("some words. ", "é", "many words of prose and more\n", "x,1;\n", "a b\u00a0c "):
        for at in (0, 5_000_000):
            for secret in (plain, once, code(plain.encode())):
                raw = filler * (at // len(filler)) + " " + secret + " " + filler * ((5_500_000 - at) // len(filler))
                text = f"see {code(raw.encode())} there"
                assert ("zip.assign", 4, len(text) - 6) in secret_scan.find(text), (filler, at, secret)


def test_pieces_of_compressed_layers_cut_no_secret(monkeypatch):
    import base64
    import gzip

    plain, rng = 'token  =  "abcdefgh12345678"', random.Random(11)
    secrets = (plain, base64.b64encode(plain.encode()).decode(), "0123456789abcdef" * 3, "AKIA0123456789AB")
    monkeypatch.setattr(secret_scan, "CHUNK", 16)
    for _ in range(300):
        parts = ["word", "a", " ", "\n", ", ", ". ", "é", "(x)\n", " and so on "]
        raw = "".join(rng.choice(parts) for _ in range(rng.randrange(60))) + " " + (secret := rng.choice(secrets)) + "\n " + "".join(rng.choice(parts) for _ in range(60))
        text = base64.b64encode(gzip.compress(raw.encode())).decode()
        assert [s for s in secret_scan.find(text) if s[1:] == (0, len(text))], (raw, secret)


def test_secrets_in_linear_time():
    import time

    for text in ("a" * 1_000_000 + " %41", "a.b/" * 300_000 + "%zz%41", "%" * 1_000_000, "\\u" * 300_000, "a%" * 400_000 + "41", "=" * 1_000_000 + "%3d"):
        began = time.perf_counter()
        secret_scan.find(text)
        assert time.perf_counter() - began < 10, text[:9]


def test_secrets_on_awkward(docs, empty):
    assert clashing(docs).withColumn("s", secret_scan.secrets(F.col("text"))).count() == docs.count()
    assert empty.select(secret_scan.secrets(F.col("text")).alias("s")).count() == 0


# archives


def test_warc_round_trip_index_and_revisits(spark):
    same, small = "z" * 1500, "y" * 20
    rows = [(i, f"https://{'ABC'[i % 3]}.example.org/p{i % 7}?q={i}#f", same if i % 4 == 0 else small if i % 4 == 1 else f"page {i} " * 200) for i in range(40)]
    rows += [(None, None, None), (50, "http://x.org/", None), (51, "no url", ""), (52, "http://x.org/\n a", "é" * 900), (52, "http://x.org/\n a", "é" * 900)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    want = Counter()
    last = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            last[raw] = max(i, last.get(raw, -1))
    for i, _, h in rows:
        raw = (h or "").encode()
        to = last.get(raw)
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None and to != i else "response", to if to != i else None)] += 1
    keys = pages.select(warc.surt(F.col("url")).alias("key"), "page_id")
    for records, entries, limit, few in ((256, 1024, 1 << 25, 1000), (3, 2, 1 << 25, 1000), (3, 2, 200, 1000), (3, 2, 200, 5), (256, 1024, 200, 5)):
        bounds = warc.Bounds(archive_records=records, block_entries=entries, directory_bytes=limit, few_hits=few)
        written = warc.write(pages, bounds=bounds)
        most = written.archives.agg(F.max(F.size("entries"))).first()[0], written.blocks.agg(F.max("n")).first()[0]
        assert most == (3, 2) if records == 3 else most > (3, 2)
        found = warc.lookup(written, keys, bounds=bounds)
        read = found.collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read) == want
        assert all(r.payload is not None for r in read if r.record_type == "response")
    some = warc.lookup(warc.write(pages), keys.filter("page_id in (3, 52)").union(spark.createDataFrame([("no,such)/", 1)], keys.schema)))
    assert sorted(r.page_id for r in some.collect()) == [3, 52, 52]


def test_warc_popular_payloads(spark, monkeypatch):
    """Digests that are looked up by a broadcast and by the join give the same, for repeated and missing ids too."""
    monkeypatch.setattr(warc, "HOT_SHARE", 0.1)
    rows = [(i % 40 if i % 9 else None, f"http://a.org/{i}", "p" * 1200 if i % 3 else "q" * 1100 if i % 7 == 0 else str(i) * 600 if i % 2 else "small") for i in range(2500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    last = {}
    for i, _, h in rows:
        if len(h) >= 1000 and i is not None:
            last[h] = max(i, last.get(h, -1))
    shared = Counter(h for _, _, h in rows)
    want = Counter((i, u, last.get(h) if shared[h] > 1 and last.get(h) != i else None) for i, u, h in rows)
    assert Counter((r.page_id, r.url, r.refers_to) for r in warc.captures(pages).collect()) == want


def test_warc_lookup_of_a_page_reads_its_volume_and_shuffles_no_archive(spark):
    rng = random.Random(13)
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", rng.randbytes(3000).hex()) for i in range(400)], "page_id long, url string, html string").repartition(8)
    found = warc.lookup(warc.write(pages), pages.filter("page_id = 7").select(warc.surt(F.col("url")).alias("key"), "page_id"))
    assert [r.page_id for r in found.collect()] == [7]
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and re.search(r"PartitionFilters: \[.*volume#\d+ = \d", plan)


def test_surt(spark):
    row = spark.createDataFrame([("https://www.Example.com/A?b=c#d",), (None,), ("plain",)], "u string").select(warc.surt(F.col("u")).alias("k")).collect()
    assert [r.k for r in row] == ["com,example,www)/A?b=c", "", ")plain"]


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.lookup(warc.write(pages), pages.select(warc.surt(F.col("url")).alias("key"), "page_id")).count() == 0


# media


def test_matroska_round_trip_and_lacing():
    rng = random.Random(3)
    for n in (0, 1, 575, 576, 577, 30000):
        raw = mk.padded(rng.randbytes(n))
        for lacing in (mk.XIPH, mk.FIXED, mk.EBML_LACING):
            media = mk.mux(raw, lacing)
            p = mk.demux(media)
            assert b"".join(media[a:b] for _, _, a, b, _ in p.packets) == raw
            assert [x[1] for x in p.packets] == [72 * i for i in range(len(raw) // 576)]
            assert [c[2] for c in p.cues] == p.clusters and p.duration == 72 * (len(raw) // 576)
    for _ in range(200):
        frames = [bytes(rng.choice([0, 1, 100, 254, 255, 256, 700, 70000])) for _ in range(rng.randrange(2, 9))]
        for lacing in (mk.XIPH, mk.EBML_LACING):
            x = mk.laced(frames, lacing)
            assert [x[a:b] for a, b in mk.unlaced(x, 0, len(x), lacing)] == frames


def test_matroska_unknown_sizes_and_errors():
    media = mk.mux(b"a" * 576 * 100)
    at = media.index(mk.CLUSTER.to_bytes(4, "big")) + 4
    width = 9 - media[at].bit_length()
    unknown = media[:at] + bytes([(1 << (8 - width)) | ((1 << (8 - width)) - 1)]) + b"\xff" * (width - 1) + media[at + width :]
    assert mk.demux(unknown).packets == mk.demux(media).packets
    with pytest.raises(ValueError):
        mk.demux(media[:-5] + b"\x00" * 5)
    assert mk.read_vint(mk.vint(127), 0) == (127, 2) and mk.read_vint(b"\xff", 0)[0] is None


def test_matroska_cut_files_and_references(spark):
    media = mk.mux(bytes(range(250)) * 60)
    for n in (1, 4, 5, 30, 100, len(media) - 700):
        with pytest.raises(ValueError):
            mk.demux(media[:n])
    block = lambda *more: mk.element(mk.BLOCK_GROUP, b"".join([mk.element(mk.BLOCK, mk.vint(1) + b"\0\0\0" + b"frame"), *more]))
    reference = mk.element(mk.REFERENCE, b"\1")
    groups = mk.element(mk.EBML, b"") + mk.element(mk.SEGMENT, mk.element(mk.CLUSTER, mk.number(mk.TIMESTAMP, 0) + block() + block(reference) + block()))
    assert [p[4] for p in mk.demux(groups).packets] == [True, False, True]
    rows = spark.createDataFrame([(1, bytearray(media)), (2, bytearray(media[:50])), (3, None), (4, bytearray(b"\1"))], "i int, m binary")
    got = {r.i: r.p for r in rows.select("i", mk.parse(F.col("m")).alias("p")).collect()}
    assert got[1].error is None and got[2].error and got[4].error and got[2].payload is None and got[2].packets == [] and got[3].payload == b""


def test_matroska_query_columns(spark, tmp_path):
    from parlance.llm.queries import op5_matroska

    texts = [(1, "é" * 700), (2, None), (3, ""), (4, "x" * 576), (5, "y" * 40000), (6, "é" * 700)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op5_matroska(spark, str(tmp_path)).collect()}
    for i, t in texts:
        raw, r = (t or "").encode(), rows[i]
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        frames = len(payload) // 576
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        clusters, feature = -(-frames // 64), dict(x.split("=") for x in r.feature.split(";"))
        assert feature.pop("mean_sample") == str(sum(payload) / len(payload))
        assert feature == {"packets": str(frames), "tracks": "1", "clusters": str(clusters), "blocks": str(-(-frames // 8)), "cues": str(clusters), "cues_hit": str(clusters), "duration_ms": str(72 * frames)}
        assert r.media_bytes > len(payload)
    assert rows[1].media_sha256 == rows[6].media_sha256 and len({r.media_sha256 for r in rows.values()}) == 4


def test_matroska_on_awkward(docs, empty):
    rows = clashing(docs).select("text", mk.mux_text(F.col("text")).alias("m")).select("text", mk.parse(F.col("m")).alias("p"), "m").collect()
    for r in rows:
        assert r.p.payload == mk.padded((r.text or "").encode())
    assert empty.select(mk.parse(mk.mux_text(F.col("text"))).alias("p")).count() == 0


# near duplicates


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, least):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    out = {}
    for f in fps:
        out.setdefault(root(f), []).append(f)
    return {f: min((least[g] for g in own if least[g] is not None), default=None) for own in out.values() for f in own}


def check_near(rows, found):
    least = {}
    for i, f in rows:
        least[f] = min((x for x in (i, least.get(f)) if x is not None), default=None)
    want = brute_components(set(least), least)
    assert Counter((r[0], r[1] % 2**64, r[2]) for r in found) == Counter((i, f, want[f]) for i, f in rows)


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    check_near(rows, simhash.near_duplicates(clashing(docs)).collect())


@pytest.mark.parametrize("matrix,bucket", [(256, 1 << 20), (2, 1 << 20), (256, 4)])
def test_links_of_dense_fingerprints(spark, matrix, bucket):
    """Groups of near fingerprints and long chains, through the matrix, the masks and the oversized buckets."""
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(30)} | {0, 2**64 - 1}
    for f in list(fps)[:4]:
        for _ in range(25):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    chain = rng.getrandbits(64)
    for b in range(0, 40, 2):
        fps.add(chain := chain ^ (3 << b))
    bounds = simhash.Bounds(matrix, bucket)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # a bucket is passed on when batches have brought too much of it
    try:
        sorted_ = simhash.variants(nodes).coalesce(1).sortWithinPartitions("variant").mapInArrow(simhash._edges(bounds), "a long, b long")
        assert (sorted_.filter("b is null").count() > 0) == (bucket < 100)
        edges = simhash.links(nodes, bounds)
        roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    want = brute_components(fps, {f: f for f in fps})
    groups = lambda m: sorted(sorted(f for f in fps if m.get(f, f) == r) for r in {m.get(f, f) for f in fps})
    assert groups(roots) == groups(want)


def test_bucket_links_masks_equal_matrix():
    rng = random.Random(5)
    high = rng.getrandbits(32) << 32
    members = np.array(sorted({high | (0xFF0F ^ (rng.getrandbits(16))) for _ in range(300)}), np.uint64)
    variant = (32 << 32) | int(members[0] >> np.uint64(32))
    results = []
    for limit in (10_000, 2):
        a, b = simhash.bucket_links(members, variant, limit)
        parent = {int(m): int(m) for m in members}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            parent[root(x)] = root(y)
        results.append(sorted(sorted(m for m in parent if root(m) == r) for r in {root(m) for m in parent}))
    assert results[0] == results[1]


# pieces


def brute_segmentations(model, word, n):
    out = []

    def go(i, score, ids):
        if i == len(word):
            out.append((score, ids))
            return
        for j in range(i + 1, len(word) + 1):
            edge = model.scores.get(word[i:j])
            if edge:
                go(j, score + edge[1], [*ids, edge[0]])
            elif j == i + 1:
                go(j, score + model.unknown, ids + [model.bytes[b] for b in word[i:j].encode()])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])[:n]


@pytest.mark.parametrize("text", ["the cat", "a  b", "naïve 漢 ▁", "\n x", "hello", " ", "x\ty", "aa aa", "é퟿"])
def test_segmentations_equal_brute_force(text):
    model = pc.Pieces(pc.MODEL, 4)
    ids, score, nbest = model.encode(text)
    want = brute_segmentations(model, " " + text, 4)
    assert [x[0] for x in nbest] == [x[0] for x in want] and score == want[0][0]
    assert len({x[2] for x in nbest}) == len(nbest)
    assert model.decode(np.frombuffer(ids, "<i4")) == text
    for s, n, digest in nbest:
        assert any(hashlib.sha256(np.array(i, "<i4").tobytes()).hexdigest() == digest and len(i) == n and sc == s for sc, i in brute_segmentations(model, " " + text, 10**6))


def test_words_together_equal_words_alone():
    model = pc.Pieces(pc.MODEL, 3)
    rng = random.Random(6)
    words = list({"".join(rng.choice("aehnst rtio漢é\n0") for _ in range(rng.randrange(1, 14))) for _ in range(400)})
    model.learn(words)
    for w in words:
        lattice, k = pc.Lattice(w, model.table, model.unknown), model.place[w]
        assert (model.ids(w, lattice.top), lattice.best[-1], lattice.gap()) == (model.stored_ids[k], model.score[k], model.gap[k])


def test_encode_job_round_trip(docs, empty):
    rows = pc.encode(clashing(docs)).withColumn("back", pc.decode_udf()(F.col("ids"))).collect()
    assert len(rows) == docs.count() and all((r.text or "") == r.back for r in rows)
    assert all(r.nbest == [] and r.score == 0 for r in rows if not r.text)
    assert pc.encode(empty).count() == 0


# repeated passages


def brute_removed(rows):
    """rows (id, text), ids unique."""
    first, words = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words[i] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for s in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][s : s + 20]), (i, s))
    out = {}
    for i, w in words.items():
        gone = {s + k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (i, s) for k in range(20)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("way", ["cold", "hot", "many", "parts"])
def test_removed_equals_brute_force(spark, docs, monkeypatch, way):
    """Anchors as they are; hot ones by their share; hot ones by their number; keys that are indexed in parts."""
    bounds = sub.Bounds()
    if way == "hot":
        every = lambda a: a.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().filter("count > 2").select("anchor")
        monkeypatch.setattr(sub, "hot_anchors", every)  # the driver calls it
        bounds = sub.Bounds(combined=20)
    elif way == "many":
        bounds = sub.Bounds(hot_rows=3)
    elif way == "parts":
        bounds = sub.Bounds(shard_words=100, key_words=60)
    rows = [(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).filter("doc_id is not null").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sub.removed(clashing(docs.filter("doc_id is not null")), bounds=bounds).collect()}
    assert got == brute_removed(rows)
    assert sum(v[1] for v in got.values()) > 1000


def test_removed_tells_apart_documents_that_share_a_key(spark):
    rng = random.Random(14)
    w = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(None, " ".join(w[:25])), (None, "another text"), (5, " ".join(w[10:45])), (5, "short"), (5, " ".join(w)), (7, " ".join(w))]
    got = {(r.doc_id, r.kept) for r in sub.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(None, " ".join(w[:25])), (None, "another text"), (5, "short"), (7, "")} <= got
    # null's words go from the longer text of 5, and then the shorter one goes, or its words go from the longer one
    assert sum(len(k.split()) for i, k in got if i == 5) in (1 + 35, 1 + 35 + 15)


def segment_batches(rows, size):
    import pyarrow as pa

    rows = sorted(rows, key=lambda r: r[0])
    return [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + size], strict=True), sub._SEGMENT, strict=True)], schema=sub._SEGMENT) for i in range(0, len(rows), size)]


def test_bounds_of_shards_and_keys_are_taken(monkeypatch):
    """The workers' functions with small bounds: more shards and indexes, the same windows."""
    rng, rows, sizes = random.Random(16), [], []
    for i in range(60):
        words = [f"{i % 7}" + rng.choice("ab") if i % 3 else f"{i % 7}w{rng.randrange(4)}" for _ in range(rng.randrange(20, 120))]
        rows.append((i % 7, i, i, 0, None, " ".join(words).encode()))
    monkeypatch.setattr(sub, "_later", lambda text, *a, real=sub._later: sizes.append(len(text)) or real(text, *a))

    def gone(bounds):
        sizes.clear()
        batches = [*sub._indexed(bounds)(iter(segment_batches(rows, 9)))]
        covered = {(r["ord"], r["start"] + k) for b in batches for r in b.to_pylist() for k in range(r["n"])}
        return covered, len(batches), max(sizes), len(sizes)

    plain, shards, largest, _ = gone(sub.Bounds())
    small = gone(sub.Bounds(shard_words=300, key_words=200))
    assert plain and small[0] == plain and shards == 1 and small[1] > 3
    assert largest > 2000 and small[2] <= 600 and small[3] > 20  # parts are about as large as asked for
    assert sub.earlier_windows([]) == [] and sub.earlier_windows([], most=1) == []


def test_a_periodic_document_of_two_million_words(spark):
    """One key that holds all of a document: removed but for its first windows."""
    for n, bounds in ((2_000_000, sub.Bounds()), (60_000, sub.Bounds(key_words=20_000))):
        docs = spark.createDataFrame([(1, "ab " * n), (2, "x ab ab y")], "doc_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sub.removed(docs, bounds=bounds).collect()}
        assert got == {1: (n, n - 1, "ab"), 2: (4, 0, "x ab ab y")}


def test_combined_stretches_are_passed_on(docs):
    """With a small bound a task gives its combined stretches away more often."""
    import pyarrow as pa

    rng = random.Random(17)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(80)) for _ in range(40)]
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    offsets[-1] -= 1
    *_, anchor, first, _, _ = sub._stretches(data, offsets, sub.Powers())
    listed = pa.array([sorted(set(anchor.tolist()))] * len(texts), pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(range(40), pa.int64()), pa.array(texts), pa.array([[]] * 40, pa.list_(pa.int64())), listed], ["ord", "dk", "text", "anchors", "hot"])
    few, many = ([*sub._segments(n)(iter([batch] * 3))] for n in (50_000, 5))
    known = lambda found: {(r["ord"], r["start"], r["words"]) for b in found for r in b.to_pylist() if r["words"]}
    assert len(many) > len(few) and known(many) == known(few)


def test_repeated_anchors_and_hot_ones():
    import pyarrow as pa

    rng = random.Random(15)
    anchors = sorted(a for a in range(40) for _ in range(rng.choice([1, 1, 2, 4, 5, 30])))
    rows = [(a, i, i) for i, a in enumerate(anchors)]
    for size in (1, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], ["anchor", "ord", "dk"]) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in sub._repeated(4)(iter(batches)) for r in b.to_pylist()]
        n = Counter(anchors)
        assert got == [(a, i, i, n[a] > 4) for a, i, _ in rows if n[a] > 1]


def test_removed_empty(empty):
    assert sub.removed(empty).count() == 0


def test_fm_index_ranks_and_intervals():
    rng = random.Random(7)
    text = np.array([rng.randrange(1, 6) for _ in range(500)] + [0])
    index = sub.FMIndex(text, 6)
    symbols, at = np.array([rng.randrange(6) for _ in range(200)]), np.array([rng.randrange(502) for _ in range(200)])
    bwt = text[index.suffixes - 1]
    assert index.matrix.rank(symbols, at).tolist() == [int((bwt[:a] == c).sum()) for c, a in zip(symbols, at, strict=True)]
    starts = np.arange(490)
    alive, low, high = index.repeats(text, starts, 3)
    grams = Counter(tuple(text[i : i + 3]) for i in range(499))
    got = {int(a): int(h - lo) for a, lo, h in zip(alive, low, high, strict=True)}
    assert got == {i: grams[tuple(text[i : i + 3])] for i in range(490) if grams[tuple(text[i : i + 3])] > 1}


# languages


def test_language_held_out_accuracy(spark):
    rng = random.Random(8)
    letters = {"aa": "abcde ", "bb": "efghi ", "cc": "дежзи "}
    rows = [(i, "".join(rng.choice(letters[k]) for _ in range(200)), k) for i, k in enumerate(list(letters) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = lid.identify(docs).join(docs.withColumnRenamed("lang", "want"), "doc_id").filter("held_out").collect()
    assert len(out) > 20 and sum(r.lang == r.want for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_path_equals_brute_force():
    import itertools

    rng = np.random.default_rng(9)
    for _ in range(100):
        scores = rng.normal(size=(int(rng.integers(1, 7)), 3)) * 3
        best = max(sum(scores[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)) for p in itertools.product(range(3), repeat=len(scores)))
        p = lid.path(scores, 2.0)
        assert abs(sum(scores[i, k] for i, k in enumerate(p)) - 2.0 * (np.diff(p) != 0).sum() - best) < 1e-9
        label = lid._label(scores, 2.0)
        if isinstance(label, int):
            assert abs(scores[:, label].sum() - best) < 1e-9


def test_language_spans_of_mixed_text_and_awkward(spark, docs, empty):
    rows = [(i, ("the cat sat on the mat and " * 20) if i % 2 else ("die katze liegt auf dem sofa und " * 20), "en" if i % 2 else "de") for i in range(40)]
    model = lid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = "the cat sat on the mat " * 10 + "die katze liegt auf dem sofa " * 10
    r = lid._predict(model, [mixed, None, "12 !!", "слово"], lid.SWITCH)
    assert [s["lang"] for s in r[0]["spans"]] == ["en", "de"] and r[0]["lang"] in ("en", "de")
    assert r[1] == r[2] == {"lang": "und", "score": 0.0, "spans": []}
    assert r[3]["lang"] in ("en", "de") and r[3]["score"] == 0
    out = lid.identify(clashing(docs)).collect()
    assert len(out) == docs.count() and {x.lang for x in out if x.doc_id in (1000, 1001, 1002)} == {"und"}
    assert lid.identify(empty).count() == 0


# pieces that all share


def test_slices_cover_all_rows():
    import pyarrow as pa

    data, offsets = utf8(pa.array(["a", None, "bb", "c" * 50, "", "d"]).slice(1))
    assert data.tobytes() == b"bb" + b"c" * 50 + b"d"
    assert [x for a, b in slices(offsets, 10) for x in range(a, b)] == list(range(5))


def test_entry_works_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent.parent
    shutil.copytree(root / "parlance", tmp_path / "parlance", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, json; print(json.dumps([len(e.queries()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'], len(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    n, corpus, oracles = json.loads(out.stdout.splitlines()[-1])
    assert n > 80 and corpus == [] and oracles > 80


def test_pieces_that_span_words_are_refused(monkeypatch):
    import sentencepiece

    real = sentencepiece.SentencePieceProcessor.IdToPiece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "IdToPiece", lambda self, i: "▁of▁the" if i == 1000 else real(self, i))
    with pytest.raises(ValueError, match="span words"):
        pc.Pieces(pc.MODEL, 2)


def test_a_false_hash_hit_is_found():
    """Two pieces exchange their places in the hash tables: words are then searched by their characters."""
    model, want = pc.Pieces(pc.MODEL, 3), pc.Pieces(pc.MODEL, 3)
    words = [" the", " that", " there", " cat", " x"]
    want.learn(words)
    ids = [model.scores[" the"][0], model.scores[" cat"][0]]
    at = [int(np.flatnonzero(model.slots.ids == i)[0]) for i in ids]
    model.slots.ids[at] = model.slots.ids[at[::-1]]
    model.learn(words)
    for w in words:
        assert model.stored_ids[model.place[w]] == want.stored_ids[want.place[w]]


# languages once more


def brute_language(rows, held, text, switch=20.0):
    """The prediction by plain loops; rows (id, text, lang) to learn from are those not held out."""
    import math
    import unicodedata

    def mix(h):
        m = 2**64 - 1
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & m
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & m
        return h ^ h >> 31

    def find(t):
        out, word = [], ""
        for c in (t or "") + "\0":
            if c.isalpha() or (word and unicodedata.category(c) in ("Mn", "Mc")):
                word += c
            elif word:
                out.append(word)
                word = ""
        return out

    low = lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c)
    script = lambda c: next((i for i, b in enumerate(lid.SCRIPTS.values()) if any(x <= ord(c) <= y for x, y in b)), lid.OTHER)

    def grams(word):
        p = [0, *map(low, word), 0]
        return [mix((p[i - 1] << 42) ^ (p[i] << 21) ^ p[i + 1]) % lid.BUCKETS for i in range(1, len(p) - 1)]

    counts, scripts, docs = {}, {}, Counter()
    for i, t, lang in rows:
        if i is not None and not held(i) and lang is not None and t is not None:
            docs[lang] += 1
            for w in find(t):
                counts.setdefault(lang, Counter()).update(grams(w))
                scripts.setdefault(lang, Counter())[script(w[0])] += 1
    langs = [x for x in sorted(docs, key=lambda x: (-docs[x], x)) if x in counts]
    words = find(text)
    if not words or not langs:
        return "und", 0.0
    total = {x: sum(counts[x].values()) for x in langs}
    scores, known = [], False
    for w in words:
        open_ = [scripts[x][script(w[0])] > 0 and scripts[x][script(w[0])] >= lid.SCRIPT_SHARE * sum(scripts[x].values()) for x in langs]
        known |= any(open_)
        scores.append([0.0 if not any(open_) else sum(math.log((counts[x][g] + 0.1) / (total[x] + 0.1 * lid.BUCKETS)) for g in grams(w)) - (0 if o else 4 * switch) for x, o in zip(langs, open_, strict=True)])
    best, back = list(scores[0]), []
    for s in scores[1:]:
        top = max(range(len(langs)), key=lambda k: best[k])
        back.append([k if best[k] >= best[top] - switch else top for k in range(len(langs))])
        best = [max(best[k], best[top] - switch) + s[k] for k in range(len(langs))]
    path = [max(range(len(langs)), key=lambda k: best[k])]
    for step in reversed(back):
        path.append(step[path[-1]])
    weight = Counter()
    for w, k in zip(words, reversed(path), strict=True):
        weight[k] += len(w)
    top = max(weight, key=lambda k: (weight[k], -k))
    share = weight[top] / sum(weight.values())
    sums = [sum(s[k] for s in scores) for k in range(len(langs))]
    rest = max((x for k, x in enumerate(sums) if k != top), default=-math.inf)
    sure = 1 - math.exp(-max(0.0, sums[top] - rest)) if share == 1 else 1.0
    return langs[top], share * sure if known else 0.0


def test_language_predictions_equal_brute_force(spark):
    rng = random.Random(16)
    source = {"en": "the cat sat on a mat and then it went out again", "de": "die katze saß auf der matte und ging dann wieder hinaus", "ru": "кот сидел на ковре и потом опять ушёл", "hi": "नमस्ते दुनिया बिल्ली चटाई पर बैठी थी", "am": "ድመቷ ምንጣፉ ላይ ተቀመጠች"}
    say = lambda k, n: " ".join(rng.choice(source[k].split()) for _ in range(n))
    rows = [(i, say(k, rng.randrange(1, 25)), k) for i, k in enumerate(list(source) * 14)]
    rows += [(200, say("en", 12) + " " + say("de", 14), None), (201, say("ru", 9) + "; " + say("hi", 9), None), (202, "ሰላም ខ្មែរ ລາວ", None), (203, "ខ្មែរ", None), (204, "́ 12", "xx"), (205, "", "en"), (206, None, "en"), (None, say("de", 4), "de"), (207, say("en", 3).upper(), "yy"), (207, "été İstanbul", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id: r.h for r in docs.select("doc_id", lid.held_out(F.col("doc_id")).alias("h")).collect()}
    got = Counter((r.doc_id, r.lang, round(r.score, 3)) for r in lid.identify(clashing(docs)).collect())
    want = Counter((i, lang, round(score, 3)) for i, t, _ in rows for lang, score in [brute_language(rows, held.get, t)])
    assert got == want
    assert not {"xx"} & {k[1] for k in got}


@pytest.mark.parametrize("script,text", [("gujarati", "ગુજરાતી ભાષા"), ("gurmukhi", "ਪੰਜਾਬੀ ਬੋਲੀ"), ("kannada", "ಕನ್ನಡ ಭಾಷೆ"), ("malayalam", "മലയാളം ഭാഷ"), ("sinhala", "සිංහල භාෂාව"), ("oriya", "ଓଡ଼ିଆ ଭାଷା"), ("lao", "ພາສາ ລາວ"), ("khmer", "ភាសា ខ្មែរ"), ("burmese", "မြန်မာ ဘာသာ"), ("tibetan", "བོད་ སྐད"), ("ethiopic", "አማርኛ ቋንቋ"), ("cherokee", "ᏣᎳᎩ ᎦᏬᏂ"), ("devanagari", "हिन्दी भाषा"), ("bengali", "বাংলা ভাষা"), ("tamil", "தமிழ் மொழி"), ("telugu", "తెలుగు భాష"), ("mongolian", "ᠮᠣᠩᠭᠣᠯ ᠬᠡᠯᠡ")])
def test_words_of_a_script_are_whole(script, text):
    first, _, starts, ends, of, _, _ = lid._words([text], lid.BUCKETS)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == [w.strip("་") for w in text.split()]
    assert set(of.tolist()) == {list(lid.SCRIPTS).index(script)}
