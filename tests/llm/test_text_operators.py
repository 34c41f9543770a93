"""Secrets, token counts, decontamination, quality and toxicity."""

import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import math
import random
import re
import time
import urllib.parse
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from turnloom.llm import decontamination as dc
from turnloom.llm import quality, secrets, toxicity
from turnloom.llm.text_features import distinct_share, shape_terms
from turnloom.llm.token_counts import MARK, VOCABULARY, UnigramCounter, pieces_of, token_counts

DOCS = "doc_id long, text string"
SECRET = "token: abcdefgh123"


def b64(x):
    return base64.b64encode(x.encode() if isinstance(x, str) else x).decode()


def spans(text):
    return [(k, s, e) for s, e, k, _ in secrets.secrets_in(text)[0]]


def test_base_spans_by_the_rules():
    assert spans('SECRET = x token=\'okokok\' Api_Key : "Abc/d=="') == [("assign", 11, 24), ("assign", 26, 44)]
    assert spans("secret=token:abcdefg") == [] and spans("paſſword=abcdef toKen=abcdef") == []
    assert spans("AKIA" + "A" * 15) == [] and spans("xAKIA" + "A" * 16 + "b") == [("access", 1, 21)]
    assert spans("g" + "0a" * 12 + "G" + "0" * 23) == [("hex", 1, 25)]
    assert spans("é😀 token=" + "0" * 24) == [("assign", 3, 33), ("hex", 9, 33)]


@pytest.mark.parametrize(
    "wrap",
    [
        b64, lambda s: b64(b64(s)), lambda s: urllib.parse.quote(b64(s), safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"%{b:02X}" for b in s.encode()),
        lambda s: b64(gzip.compress(s.encode())), lambda s: b64(zlib.compress(s.encode())), lambda s: b64(bz2.compress(s.encode())), lambda s: b64(lzma.compress(s.encode())),
        lambda s: b64(zstandard.compress(s.encode())), lambda s: "".join(f"%{b:02x}" for b in gzip.compress(s.encode())), lambda s: b64(gzip.compress(b64("".join(f"\\x{ord(c):02x}" for c in s)).encode())),
        lambda s: base64.urlsafe_b64encode((s + "??>>").encode()).decode(),
    ],
)
def test_wrapped_secrets_are_found_in_place(wrap):
    body = wrap(SECRET)
    text = f"é before {body} after"
    found = [(k, s, e) for k, s, e in spans(text) if k == "assign"]
    assert len(found) == 1 and found[0][1] >= 9 and found[0][2] <= 9 + len(body) and found[0][2] - found[0][1] > len(body) / 2


def test_half_escaped_secret_and_cycles():
    assert spans("pass%77ord=hunter22 x") == [("assign", 0, 19)]
    assert spans(" \\ud83d\\ude00 token=abcdef") == [("assign", 14, 26)]
    assert spans("%2541" * 50) == [] and spans("%" * 9) == [] and spans("") == []
    assert secrets.secrets_in(b64(gzip.compress(b"a" * 1000)))[1] == 1


def broken_lines(data, columns=76):
    text = b64(data)
    return "\n".join(text[i : i + columns] for i in range(0, len(text), columns))


PROSE = " ".join(random.Random(4).choice(("red", "green", "blue", "stone", "river")) + str(i) for i in range(600))


@pytest.mark.parametrize(
    "body",
    [
        "".join(f"%{b:02X}" for b in b"\xe9" + SECRET.encode()), b64("\x1b[0m" + SECRET), b64("caf\xe9 ".encode("latin-1") + SECRET.encode()), b64(SECRET.encode("utf-16")), b64(SECRET.encode("utf-32-be")),
        broken_lines(gzip.compress((PROSE + SECRET).encode())), broken_lines(gzip.compress((PROSE + SECRET).encode()), 61).replace("\n", "\r\n  "), broken_lines((PROSE[:90] + SECRET).encode(), 20),
        b64(gzip.compress(b"one member") + gzip.compress(SECRET.encode())), b64(bz2.compress(b"one member") + bz2.compress(SECRET.encode())), b64(zstandard.compress(b"one") + zstandard.compress(SECRET.encode())),
        b64(lzma.compress(b"one member") + lzma.compress(SECRET.encode())), b64(gzip.compress((SECRET + " " + PROSE).encode())[:-30]), b64(zlib.compress((SECRET + " " + PROSE).encode())[:-9]),
    ],
)
def test_secrets_in_odd_layers(body):
    """Bytes that aren't UTF-8, control characters, wide letters, broken lines, several members, streams that break off."""
    text = f"é before\n{body}\nafter"
    found = [(s, e) for k, s, e in spans(text) if k == "assign"]
    # A word on the next line may be taken for the end of the run too; that is one more span.
    assert any(9 <= s and e <= 9 + len(body) for s, e in found) and all(9 <= s and e <= 15 + len(body) for s, e in found)


def test_any_nesting_is_undone():
    wraps = [
        lambda s: b64(s), lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"%{b:02x}" for b in s.encode()), lambda s: "".join(f"\\u{ord(c):04X}" for c in s), lambda s: b64(gzip.compress(s.encode())),
        lambda s: b64(s.encode("utf-16-le")), lambda s: broken_lines(zlib.compress(s.encode())), lambda s: "".join(f"%{b:02x}" for b in bz2.compress(s.encode())),
    ]
    rng = random.Random(6)
    for _ in range(120):
        body = SECRET
        for _ in range(rng.randrange(1, 5)):
            body = rng.choice(wraps)(body)
        text = f"é {body} end"
        found = [(s, e) for k, s, e in spans(text) if k == "assign"]
        assert found and all(2 <= s < e <= 2 + len(body) for s, e in found), body[:200]


def test_bombs_are_counted_and_large_layers_come_in_windows(monkeypatch):
    bomb = b64(gzip.compress(b"a b c d e f " * 50_000 + SECRET.encode() + b" a b c d" * 50_000))
    assert secrets.secrets_in(bomb)[0] == [(0, len(bomb), "assign", 1)]
    monkeypatch.setattr(secrets, "WINDOW", 100_000)
    monkeypatch.setattr(secrets, "OVERLAP", 1_000)
    assert secrets.secrets_in(bomb)[0] == [(0, len(bomb), "assign", 1)]
    monkeypatch.setattr(secrets, "MOST_BYTES", 300_000)
    found, _, refused = secrets.secrets_in(bomb)
    assert not found and refused == 1


@pytest.mark.parametrize("n", [1, 7, 8, 9, 10, 300, 29_990])
def test_escapes_of_escapes_are_undone_however_deep(n):
    """In little time: a layer for each would be scanned for each."""
    for text in (f"p%{'25' * n}61ssword=abcdef", "p\\" + "u005c" * n + "u0061ssword=abcdef", "p\\" + "x5C" * n + "x61ssword=abcdef"):
        began = time.perf_counter()
        found = spans(text)
        assert ("assign", 0, len(text)) in found and time.perf_counter() - began < 2.0
        assert not any(k != "hex" for k, s, e in found if (s, e) != (0, len(text)))


def test_large_dictionaries_are_decoded_and_larger_ones_counted(monkeypatch):
    body = f"{'filler ' * 500}{SECRET}{' filler' * 500}".encode()  # long enough to be compressed, not stored

    def xz(size):
        return b64(lzma.compress(body, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": size}]))

    found, _, unopened = secrets.secrets_in(xz(512 << 20))
    assert [s[2] for s in found] == ["assign"] and unopened == 0
    packed = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(window_log=27, enable_ldm=True))
    long = packed.compressobj()
    wide = b64(long.compress(body) + long.flush())
    assert [s[2] for s in secrets.secrets_in(wide)[0]] == ["assign"]
    monkeypatch.setattr(secrets, "DECODER_BYTES", 16 << 20)
    for text in (xz(512 << 20), wide):
        assert secrets.secrets_in(text)[2] >= 1


def test_no_bound_on_what_is_unpacked(monkeypatch):
    monkeypatch.setattr(secrets, "MOST_BYTES", 100)
    text = b64(gzip.compress(b" " * 5000 + SECRET.encode()))
    assert secrets.secrets_in(text)[2] == 1 and secrets.secrets_in(text)[0] == []
    found, _, unopened = secrets.secrets_in(text, None)
    assert [s[2] for s in found] == ["assign"] and unopened == 0


def _every_span(text, whole=None, seen=None):
    """Secrets of a text and of all that single steps of decoding make of it, by an exhaustive recursion over plain texts: the set of (kind, secret's text)."""
    seen = set() if seen is None else seen
    if text in seen:
        return set()
    seen.add(text)
    out = {(k, text[s:e]) for s, e, k in secrets.base_spans(text)}
    inner = [urllib.parse.unquote(text, errors="replace")]
    inner.append(re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), text))
    for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", text):
        body = m[0].rstrip("=")
        body = body[: len(body) - (len(body) % 4 == 1)]
        data = base64.b64decode(body + "=" * (-len(body) % 4))
        for opener in (gzip.decompress, bz2.decompress, lzma.decompress, lambda d: d):
            try:
                inner.append(opener(data).decode("utf-8", "replace").replace("\0", ""))
                break
            except (OSError, EOFError, lzma.LZMAError, zlib.error):
                continue
    for x in inner:
        out |= _every_span(x, None, seen)
    return out


def test_all_nested_spans_against_an_exhaustive_decoder():
    """Random nestings of up to four steps over several secrets: the same secrets are found, and each in its place."""
    rng = random.Random(12)
    steps = [b64, lambda s: "".join(f"%{b:02X}" for b in s.encode()), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: b64(gzip.compress(s.encode())), lambda s: b64(bz2.compress(s.encode()))]
    for _ in range(60):
        parts = []
        for i in range(rng.randint(1, 3)):
            body = f"{rng.choice(('token', 'secret', 'api_key'))}: value{rng.randrange(10**6):06d}x"
            for _ in range(rng.randint(0, 4)):
                body = rng.choice(steps)(body)
            parts.append(body)
        text = " , ".join(parts)
        want = {kind for kind, secret in _every_span(text)}
        plain = {secret for kind, secret in _every_span(text) if kind == "assign"}
        found = spans(text)
        assert want == {k for k, _, _ in found}
        for k, s, e in found:
            if k == "assign":  # what stands there decodes to one of the secrets
                assert {x for kind, x in _every_span(text[s:e]) if kind == "assign"} & plain
        at = 0
        for body in parts:  # and every part with a secret in it has a span
            end = at + len(body)
            assert any(k == "assign" and at <= s and e <= end for k, s, e in found), body
            at = end + 3


def test_long_text_with_one_escape_needs_little_memory():
    import tracemalloc

    text = "word " * 200_000 + "%41 " + SECRET
    tracemalloc.start()
    assert spans(text) == [("assign", 1_000_004, 1_000_022)]
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def base_by_hand(text):
    """The base rules, one place of the text after the other."""
    out, n = [], len(text)
    value, upper, low = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), set("0123456789abcdef")
    fold = "".join(c.lower() if c.isascii() else c for c in text)

    def run(i, of):
        while i < n and text[i] in of:
            i += 1
        return i

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if fold.startswith(word, i):
                j = i + len(word)
                j = run(j + (text[j : j + 1] in ('"', "'")), " ")
                if text[j : j + 1] in (":", "="):
                    j = run(j + 1, " ")
                    start = j + (text[j : j + 1] in ('"', "'"))
                    if (end := run(start, value)) > start:
                        return start, end
        return None

    i = 0
    while i < n:
        if found := assign(i):
            out += [(i, found[1], "assign")] * (found[1] - found[0] >= 6)
        i = found[1] if found else i + 1
    i = 0
    while i < n:
        end = run(i + 4, upper) if text.startswith("AKIA", i) else i
        out += [(i, end, "access")] * (end - i >= 20)
        i = end if end - i > 4 else i + 1
    i = 0
    while i < n:
        end = run(i, low)
        out += [(i, end, "hex")] * (end - i >= 24)
        i = max(end, i + 1)
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_base_spans_against_a_plain_scan():
    rng = random.Random(8)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "AKIA", "A1B2C3D4E5F6G7H8", "0a1b2c3d4e5f", "deadbeef", '"', "'", " ", "  ", ":", "=", "abc", "x/y+z", "é", "\n", "ſ"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        assert secrets.base_spans(text) == base_by_hand(text), text
    assert secrets.base_spans("AKIAAKIA" + "B" * 20) == base_by_hand("AKIAAKIA" + "B" * 20)


def test_secrets_query_columns(spark, tmp_path):
    rows = [(1, f"x {SECRET} {b64(SECRET)}"), (2, None), (3, ""), (3, ""), (None, SECRET)]
    spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r)[:6] for r in secrets.op2_secrets(spark, str(tmp_path)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    none = (0, 0, 0, sha(""), "")
    assert got == sorted([(1, 1, 0, 0, sha("assign:2:20"), "assign:2:20,assign:21:45"), (2, *none), (3, *none), (3, *none), (None, 1, 0, 0, sha("assign:0:18"), "assign:0:18")], key=str)


def test_token_counts_equal_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    pieces = pieces_of(VOCABULARY)
    reference = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=True))
    reference.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True)
    rng = random.Random(1)
    texts = ["", "  a  b ", "\n x\ty", "<0x0A> <unk> ▁x", "日本語テキスト😀😀 é", "a" * 700, "<s></s>"]
    texts += ["".join(rng.choice("abc  ▁é漢😀\n<0x4>the") for _ in range(60)) for _ in range(200)]
    want = [len(e.ids) for e in reference.encode_batch(texts, add_special_tokens=False)]
    got = token_counts(spark.createDataFrame([*enumerate(texts), (None, "a b"), (900, None)], DOCS).withColumn("n_tokens", F.lit("x"))).collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: -1 if r.doc_id is None else r.doc_id)][1:-1] == want
    assert {r.doc_id: r.n_tokens for r in got}[900] == 0


def test_viterbi_ties_take_the_first_start():
    counter = UnigramCounter([("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("ab", -1.5), ("b", -1.5), (MARK, -1.0)])
    assert counter.best("aa") == 1 and counter.best("aab") == 2 and counter.best("z") == 1 and counter.best("é") == 2


def overlaps_by_hand(docs, items):
    """Every diagonal of every document and item, without an index or seeds."""
    out = {}
    for d, t in docs:
        a = re.findall(r"\w+", (t or "").lower())
        for i, s in items:
            b = re.findall(r"\w+", (s or "").lower())
            if d is None or i is None or len(b) < dc.MIN_ITEM:
                continue
            for shift in range(-len(b) + 1, len(a)):
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                same = [b[k] == a[shift + k] for k in range(lo, hi)]
                if sum(same) >= 0.8 * len(b) or (sum(same) >= dc.WHOLE and best_stretch(same) >= dc.WHOLE):
                    out[d, i] = True
    return out


def best_stretch(same):
    """Matches of the stretch with the best sum, of equal ones that which ends first and, of these, the shortest."""
    return max((sum(1 if z else -dc.SUBSTITUTION for z in same[x:y]), -y, x, sum(same[x:y])) for x in range(len(same)) for y in range(x + 1, len(same) + 1))[3]


def test_no_stretch_is_without_a_seed():
    """All ways to lay matches and substitutions without a seed: none is a best stretch of WHOLE matches.

    No beginning of a best stretch has a negative sum, and its end has a greater sum than all before.
    """
    longest = max(map(len, dc.HEAVY))
    seeded = lambda bits: any(len(bits) >= len(m) and all(b or c == "0" for b, c in zip(bits[-len(m) :], m)) for m in dc.HEAVY)
    states, seen = [((), 0, 0, 0)], set()
    while states:
        bits, total, matches, most = states.pop()
        for same in (True, False):
            bits_, total_ = (*bits, same)[-longest:], total + (1 if same else -dc.SUBSTITUTION)
            state = (bits_, total_, min(matches + same, dc.WHOLE), max(most, total_))
            if total_ < 0 or seeded(bits_) or state in seen:
                continue
            assert state[2] < dc.WHOLE or total_ <= most, state
            seen.add(state)
            states.append(state)
    assert len(seen) > 100


def test_index_against_all_diagonals():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(500)]
    items, docs = [], []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randrange(8, 70))]
        items.append((i, " ".join(words)))
        rate = rng.choice((0.05, 0.15, 0.2, 0.25, 0.35))
        start = rng.randrange(len(words)) if i % 2 else 0
        changed = ["changed" if rng.random() < rate else w for w in words[start:]]
        docs.append((i, " ".join([rng.choice(vocab) for _ in range(rng.randrange(20))] + changed + [rng.choice(vocab) for _ in range(rng.randrange(20))])))
    index = dc.Index([(i, dc.plain_words(s)) for i, s in items])
    got = {(d, items[item][0]) for d, t in docs for item, *_ in index.overlaps(dc.plain_words(t))}
    want = set(overlaps_by_hand(docs, items))
    assert got == want and 15 < len(want) < 60


def test_decontamination_both_ways(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([8, 14, 30, 45])))) for i in range(12)] + [(50, None), (None, "a b c d e f g h i"), (51, "one two three"), (52, "")]
    docs = [(100 + i, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(10)] + [(1, None), (2, ""), (None, items[0][1])]
    for i in range(12):
        w = items[i][1].split()
        for k in range(2, len(w), 6):
            w[k] = "changed"
        text = " ".join([rng.choice(vocab) for _ in range(20)] + [x.upper() + "," for x in w] + ["end"])
        docs += [(i + 10, text), (i + 30, "pre " + items[i][1])] + ([(i + 10, text)] if i % 3 == 0 else [])
    a = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got, joined = (sorted(dc.contaminated(a, b, limit).collect()) for limit in (dc.INDEX_LIMIT, 0))
    assert got == joined and {(r.doc_id, r.item_id) for r in got} == set(overlaps_by_hand(docs, items))
    assert {r.doc_id for r in got} >= {i + 30 for i in range(12)} and not {r.doc_id for r in got} & {100 + i for i in range(10)}
    assert dc.contaminated(a.limit(0), b).count() == 0 and dc.contaminated(a, b.limit(0)).count() == 0


def test_decontamination_finds_every_placement_and_short_items(spark):
    for n in range(1, 16):
        for gone in itertools.combinations(range(n), n // 5 if n >= dc.MIN_ITEM else 0):
            assert any(not {p + j for j, c in enumerate(m) if c == "1"} & set(gone) for m in dc.masks_of(n) for p in range(n - len(m) + 1))
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (1, 3, 5, 7, 8, 9, 10, 15, 20, 25, 30)]
    docs, want = [], set()
    rng = random.Random(3)
    for n, text in items:
        for trial in range(30):
            w = text.split()
            for k in rng.sample(range(n), n // 5 if n >= dc.MIN_ITEM else trial % 2):
                w[k] = "changed"
            docs.append((n * 100 + trial, " ".join(["a", "b", *w, "c"])))
            if n >= dc.MIN_ITEM or trial % 2 == 0:
                want.add((n * 100 + trial, n))
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for limit in (dc.INDEX_LIMIT, 0):
        assert {(r.doc_id, r.item_id) for r in dc.contaminated(a, b, limit).collect()} == want


def labelled(spark, n=400):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("an", "the", "or", "in", "st", "re") for b in ("ing", "ed", "ly", "on", "at")]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 else [w[0]] * len(w)
        if toxic and not bad:
            w[rng.randrange(len(w))] = rng.choice(["grolf", "mipplesnak", "mipplesnaks", "mipplesnakin"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic and not bad)))
    docs += [(1000, None), (1001, ""), (None, "the"), (1002, "the ing " * 30000), (3, docs[3][1])]
    labels += [(None, 1, 0), (1000, None, None), (5000, 1, 1)]
    return spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    scored = quality.quality_scores(docs, quality.quality_model(docs, labels))
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    held = scored.where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored.collect() if r.doc_id is not None)
    kept = quality.keep_good(docs, quality.quality_model(docs, labels))
    assert kept.columns == docs.columns and abs(kept.count() - scored.where("predicted = 1").count()) == 0


def test_distinct_words_are_taken_from_the_whole_text():
    varied, loop = [b"w%d" % i for i in range(200)], [b"a", b"b"] * 100
    assert distinct_share(varied) == 1 and distinct_share([]) == 0 and distinct_share([b"a", b"a"]) == 0.5
    assert distinct_share(varied + loop * 9) == distinct_share(loop * 9 + varied) == pytest.approx((1 + 9 * 0.01) / 10)
    assert distinct_share(varied + varied[:50]) == 1
    level = lambda words: {t for t in shape_terms(b" ".join(words), words) if t.startswith(b"#distinct")}
    assert level(varied + loop * 9) == level(loop * 9 + varied) != level(varied)


def test_quality_without_labels(spark):
    docs, labels = labelled(spark, 20)
    assert {r.score for r in quality.quality_scores(docs, quality.quality_model(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), quality.quality_model(docs, labels)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark, 800)
    scored = toxicity.toxicity_scores(docs, toxicity.toxicity_model(docs, labels))
    held = scored.where("held_out").join(labels.withColumnRenamed("toxic", "label"), "doc_id").where("label is not null").collect()
    assert len(held) > 100 and sum(r.toxic == r.label for r in held) / len(held) > 0.97
    assert scored.count() == docs.count() and scored.where("severity < 0 or severity > 3 or severity is null").count() == 0


def test_toxicity_without_labels_and_order_of_thresholds(spark):
    docs, labels = labelled(spark, 20)
    model = toxicity.toxicity_model(docs, labels.where("toxic = 0"))
    assert {r.toxic for r in toxicity.toxicity_scores(docs, model).collect()} == {0}
    texts = ["bad bad thing"] * 30 + ["fine day"] * 30
    model = toxicity.fit([toxicity.words_in(t) for t in texts], [toxicity.marks_of(t) for t in texts], [1] * 30 + [0] * 30)
    assert list(model.thresholds) == sorted(model.thresholds)


def test_votes_against_a_plain_sum():
    """Scores by the rule, one document and neighbour after the other, with many equally near neighbours."""
    rng = np.random.default_rng(2)
    base = rng.integers(-2, 3, size=(12, 4)).astype(np.float32)
    sample = base[rng.integers(0, 12, 90)]
    sample = sample[np.abs(sample).sum(axis=1) > 0]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    labels = rng.integers(0, 2, len(unit)).astype(float)
    model = quality.Model(np.zeros((1, 4), np.float32), unit, labels, 0.25)
    asked = np.concatenate([unit[:40], -unit[:5], np.zeros((1, 4), np.float32)])
    for v, got in zip(asked, model.scores(asked)):
        near = sorted((-float(c), i) for i, c in enumerate((v[None] @ unit.T)[0]))[: quality.NEIGHBOURS]
        weight = [max(-c, 0.0) ** quality.SHARPNESS for c, _ in near]
        want = sum(w * labels[i] for w, (_, i) in zip(weight, near)) / sum(weight) if sum(weight) else 0.25
        assert got == pytest.approx(want, abs=1e-6)


def test_quality_takes_the_same_sample_however_the_tables_are_cut(spark):
    docs, labels = labelled(spark)
    model, again = quality.quality_model(docs, labels, 50), quality.quality_model(docs.repartition(9), labels, 50)
    assert len(model.labels) == 50 and (model.vectors == again.vectors).all() and (model.labels == again.labels).all()


def test_toxicity_scores_and_fit_by_the_formulas():
    rng = random.Random(1)
    clean, bad = [f"word{i}" for i in range(60)], ["grolfing", "grolfed", "mipple", "snarked"]
    texts = [" ".join(rng.choice(clean) for _ in range(30)) + "".join(f" {rng.choice(bad)}" for _ in range(k)) for i in range(400) for k in [(i % 4 == 0) * (1 + i % 3)]]
    toxic = [int(i % 4 == 0) for i in range(400)]
    rows = [toxicity.words_in(t) for t in texts]
    model = toxicity.fit(rows, [[i] for i in range(400)], toxic)
    assert model.weights
    for t in ["", None, *texts[:30], "Grolfing grolfed! x"]:
        z = sum(model.weights.get(term, 0.0) for term in toxicity.terms_of(toxicity.words_in(t)))
        assert model.above(t) == pytest.approx([1 / (1 + math.exp(min(40, max(-40, b - z)))) for b in model.thresholds])
    # No small change of a weight or a threshold makes the penalised likelihood much better.
    grades = toxicity.severity_grades(rows, np.array(toxic))
    assert set(grades[np.array(toxic) == 0]) == {0} and set(grades) <= {0, 1, 2, 3}

    def likelihood(weights, thresholds):
        total, weight = 0.0, [1.0 if g == 0 else toxic.count(0) / toxic.count(1) for g in grades]
        for row, g, part in zip(rows, grades, weight):
            z = sum(weights.get(term, 0.0) for term in toxicity.terms_of(row))
            p = [1.0, *(1 / (1 + math.exp(b - z)) for b in thresholds), 0.0]
            total += part / sum(weight) * math.log(max(p[g] - p[g + 1], 1e-12))
        return total - toxicity.PENALTY / 2 * sum(w * w for w in weights.values())

    best = likelihood(model.weights, model.thresholds)
    for term in list(model.weights)[:6]:
        for step in (-0.3, 0.3):
            assert likelihood(model.weights | {term: model.weights[term] + step}, model.thresholds) <= best + 1e-3
    for k in range(3):
        for step in (-0.3, 0.3):
            assert likelihood(model.weights, [b + step * (i == k) for i, b in enumerate(model.thresholds)]) <= best + 1e-3


def test_text_operators_over_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], DOCS)
    assert secrets.find_secrets(none).count() == 0 and token_counts(none).count() == 0
    docs, labels = labelled(spark, 60)
    model = toxicity.toxicity_model(docs, labels)
    assert toxicity.toxicity_scores(none, model).count() == 0 and toxicity.toxicity_model(none, labels).weights == {}
    long = " ".join(["word token one"] * 100_000)
    items = spark.createDataFrame([(1, " ".join(f"i{k}" for k in range(20)))], "item_id long, text string")
    one = spark.createDataFrame([(1, long + " " + " ".join(f"i{k}" for k in range(20)))], DOCS)
    assert dc.contaminated(one, items).first().doc_start == 300_000
    assert token_counts(one).first().n_tokens > 300_000 and secrets.find_secrets(one).first().spans == []


@pytest.mark.parametrize("spread", [4, 40])
def test_quality_s_projection_is_the_truncated_svd(spread):
    """Of texts with fewer independent directions than dimensions, and with more."""
    from turnloom.llm.text_features import SHAPES, WORDS, features

    rng = random.Random(4)
    texts = [" ".join(rng.choice(("ab", "cd", "Ef!", "gh", "99", "ij.", "kl", "m")) + str(rng.randrange(spread)) for _ in range(rng.randrange(3, 50))) for _ in range(90)]
    rows = [(*features(t), i % 2) for i, t in enumerate(texts)]

    def dense(features_):
        out = np.zeros((len(features_), WORDS + SHAPES))
        for i, (columns, values, *_) in enumerate(features_):
            for c, v in zip(columns, values):
                out[i, c] = v
        return out

    plain = dense(rows)
    weight = np.log(91 / (1 + (plain > 0).sum(axis=0))) + 0.1
    weight[:WORDS] *= quality.WORD_WEIGHT
    _, sizes, right = np.linalg.svd(plain * weight, full_matrices=False)
    right = right[: quality.DIMENSIONS][sizes[: quality.DIMENSIONS] > 1e-6 * sizes[0]]
    assert (len(right) < quality.DIMENSIONS) == (spread == 4)

    def latent(features_):
        out = (dense(features_) * weight) @ right.T
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    model = quality.fit(rows)
    assert np.abs(model.vectors @ model.vectors.T - latent(rows) @ latent(rows).T).max() < 1e-3
    others = [*texts[:20], "zz yy", "ab1 cd2 Ef!3", ""]
    assert np.abs(np.stack([model.vector(t) for t in others]) @ model.vectors.T - latent([features(t) for t in others]) @ latent(rows).T).max() < 1e-3
