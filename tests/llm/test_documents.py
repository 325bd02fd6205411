"""Operators over documents (1 to 5, 7, 8, 10) against brute force, on odd rows and on the small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import class_lm, license_scan, near_dedup, packing, pii, quality_rules, sentencepiece_scan, token_counts

LONG = " ".join(f"w{k % 977} x{k * k % 1231}" for k in range(12_000))
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 2
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "word"),
    (5, "two words"),
    (6, COPY),
    (6, COPY),
    (7, COPY + "again"),
    (8, LONG),
    (None, "a row without an id, mail a.b@c-d.example.org and call +1 (499) 555-6503 now"),
    (9, "Ünïcode ÉCOLE 日本語 😀 ▁ \x00 it's can't <|endoftext|> <|ENDOFTEXT|> \\ á ﬁ"),
    (10, "x" * 70_000),
    (-11, "negative id 10.0.0.1 and 999.1.1.1 with 4111 1111 1111 1111 or 4111111111111112"),
]
#: Names that operators use themselves.
EXTRA = ("fp", "n", "key", "row", "entry", "word", "length", "c", "salt", "n_words")


def frame(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    for k, name in enumerate(EXTRA):
        df = df.selectExpr("*", f"{k} as {name}")
    return df


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(docs) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def both(docs, odd):
    return [(docs, pairs(docs)), (odd, ODD)]


def key(x):
    return tuple((v is not None, v) if not isinstance(v, float) else (True, round(v, 6)) for v in x)


def same(df, expected, names):
    rounded = lambda x: tuple(round(v, 6) if isinstance(v, float) else v for v in x)
    found = sorted((rounded(r[n] for n in names) for r in df.select(*names).collect()), key=key)
    assert found == sorted(map(rounded, expected), key=key)


# --- 1


def test_token_counts(spark, docs, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = token_counts.byte_bpe(path).encode_ordinary
    for df, data in both(docs, odd):
        # blocks of an odd number of ids, far shorter than most documents
        same(token_counts.document_token_counts(spark, df, path, block_bytes=502), [(i, len(encode(t or ""))) for i, t in data], ["doc_id", "n_tokens"])
    assert token_counts.document_token_counts(spark, empty, path).count() == 0


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("whole", [1 << 20, 4])
def test_flat_files(spark, tmp_path, width, whole):
    """Whole files and records give the same: prime numbers of ids, ids cut off at the end, empty files."""
    rng, eod = np.random.default_rng(3), 7
    files = {"a": [7, 7, 1, 2, 7, 3, 7, 7], "b": [1, 2, 3], "c": [7], "d": rng.integers(0, 9, 1000).tolist(), "e": [], "prime": rng.integers(0, 9, 997).tolist(), "cut": rng.integers(0, 9, 500).tolist()}
    expected = []
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, token_counts.DTYPES[width]).tobytes() + b"\7" * (width - 1 if name == "cut" else 0))
        docs, cut = [[]], False
        for x in ids:
            if x == eod:
                docs.append([])
            else:
                docs[-1].append(x)
        for k, d in enumerate(docs):
            if cut := k < len(docs) - 1 or d:
                expected.append((name, k, len(d), np.array(d[:3], token_counts.DTYPES[width]).tobytes(), k < len(docs) - 1))
    blocks = token_counts.read_blocks(spark, str(tmp_path), width, 16, whole)
    found = token_counts.token_counts(spark, blocks, eod, width, 3, span=64).collect()
    assert sorted((r["file"].rsplit("/")[-1], r["ordinal"], r["n_ids"], bytes(r["head"]), r["closed"]) for r in found) == sorted(expected)


def test_record_bytes():
    for n in (1, 7, 64, 997, 1000, 2 * 997, 1 << 12):
        for most in (1, 16, 100):
            assert token_counts.record_bytes(n, most) == max(k for k in range(1, most + 1) if n % k == 0)


# --- 2


def test_license_scan(spark, odd, empty):
    mit = license_scan.LICENSES["MIT"]
    variants = ["Copyright (c) 2020 Someone\n\n" + mit, mit.upper().replace(",", " ;"), mit.replace("sublicense", "sub-license"), mit + " more"]
    df = frame(spark, [(k, t) for k, t in enumerate(variants)] + [(9, "x\nReleased under the MIT Licence\nSPDX-License-Identifier: Apache-2.0")])
    known = license_scan.known_digests(spark)
    found = {r["doc_id"]: (r["license_id"], r["notices"]) for r in license_scan.license_scan(df, known).collect()}
    assert found == {0: ("MIT", ""), 1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 9: (None, "Apache-2.0,MIT")}
    out = license_scan.license_scan(odd, known).collect()
    assert len(out) == len(ODD) and all(r["license_id"] is None for r in out)
    blank = hashlib.sha256(b"").hexdigest()
    assert {r["doc_id"] for r in out if r["canonical_sha256"] == blank} == {1, 2, 3}
    assert license_scan.license_scan(empty, known).count() == 0
    ties = license_scan.known_digests(spark, {"b": "Same text.", "a": "same TEXT", "none": "..."})
    assert [r["license_id"] for r in ties.collect()] == ["a"]
    assert license_scan.license_scan(df, known.limit(0), {}).filter("license_id is not null").count() == 0


def test_whole_licence_files(spark):
    """Files as they are distributed: titles, copyright lines, wrapped lines, long texts by their digests."""
    import textwrap
    from pathlib import Path

    wrap = lambda x: "\n\n".join(textwrap.fill(p, 78) for p in x.split("\n"))
    files = [(k, f"{title}\n\nCopyright (c) 2019-2024, Some Holder <a@b.org>\nAll rights reserved.\n\n{wrap(text)}\n") for k, text in license_scan.LICENSES.items() for title in license_scan.TITLES[k]]
    files += [(k, wrap(text)) for k, text in license_scan.LICENSES.items()]
    shared = Path("/usr/share/common-licenses")
    for name, k in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("MPL-2.0", "MPL-2.0"), ("LGPL-2.1", "LGPL-2.1")):
        if (shared / name).exists():
            text = (shared / name).read_text()
            files += [(k, text), (k, text.upper().replace("HTTP:", "https:")), (k, text.replace("\n", "\r\n"))]
    out = license_scan.license_scan(frame(spark, [(n, t) for n, (_, t) in enumerate(files)]), license_scan.known_digests(spark))
    assert {r["doc_id"]: r["license_id"] for r in out.collect()} == {n: k for n, (k, _) in enumerate(files)}
    lines = [(0, "x\nLicensed under CC BY-NC 4.0.\ny"), (1, "(c) You must retain this"), (2, "copyright notice and this permission notice")]
    rows_ = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, lines), license_scan.known_digests(spark)).collect()}
    assert rows_[0]["notices"] == "CC-BY-NC-4.0" and rows_[1]["canonical_sha256"] == hashlib.sha256(b"c you must retain this").hexdigest()
    assert rows_[2]["canonical_sha256"] == hashlib.sha256(b"copyright notice and this permission notice").hexdigest()


# --- 3


def counted(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_rules(docs, odd, empty):
    for df, data in both(docs, odd):
        expected = []
        for i, t in data:
            n, *rest = counted(t)
            expected.append((i, n, *rest, n < 20 or 100 * rest[-1] > 30 * n))
        out = quality_rules.quality_rules(df)
        same(out, expected, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
        assert out.filter("kept and base_failed").count() == 0
        kept = quality_rules.kept_documents(df)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in out.filter("kept").collect()), key=str)
    assert quality_rules.quality_rules(empty).count() == quality_rules.kept_documents(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(2, 8))
def test_repeated_words(w, size):
    windows = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
    n = Counter(windows)
    assert quality_rules.repeated_words(w, size) == len({i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(size)})


def test_rule_order(docs):
    """Order changes no verdict; a rule that rejects more for its cost comes first."""
    rules = quality_rules.RULES
    a = quality_rules.quality_rules(docs, rules)
    b = quality_rules.quality_rules(docs, (*rules[:2], *reversed(rules[2:])))
    assert rows(a) == rows(b)
    never = quality_rules.Rule("never", lambda x: x.n_repeat_words < 0)
    order = quality_rules.ordered(docs, (never, *rules))
    assert order.index(0) > order.index(1)  # few_words rejects some texts of the sample, at little cost


# --- 4

NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    out = {}
    for kind, pattern in NAIVE.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                s = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
                if not 13 <= len(d) <= 19 or s % 10:
                    continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out[kind].append(m.span())
    return out


@settings(max_examples=600, deadline=None)
@given(st.text("a@.-+1 45(", max_size=60) | st.text("0123456789.- ", max_size=60) | st.text("+019 ()-", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == naive(text)


def test_personal_data(docs, odd, empty):
    for df, data in both(docs, odd):
        expected = []
        for i, t in data:
            s = naive(t)
            base = ",".join(f"{k}:{a}:{b}" for k in NAIVE for a, b in s[k])
            expected.append((i, *(len(s[k]) for k in NAIVE), hashlib.sha256(base.encode()).hexdigest()))
        same(pii.personal_data(df, pii.revealing_terms(df)), expected, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
    assert pii.personal_data(empty, pii.revealing_terms(empty)).count() == 0


def brute_terms(data, share, min_texts=3, generalise=0.9):
    """The terms by their definition: over distinct texts, all tokens that no base span touches."""
    alone, together, of = defaultdict(set), defaultdict(set), defaultdict(set)
    texts_of_all = {t for _, t in data if t}
    for text in texts_of_all:
        spans = naive(text)
        free = {low(m[0]) for m in re.finditer(r"[^\W_]+", text) if all(m.end() <= a or m.start() >= b for x in spans.values() for a, b in x)}
        entities = {pii.entity(k, text[a:b]) for k, x in spans.items() for a, b in x}
        for e in entities:
            of[e].add(text)
        for t in free:
            alone[t].add(text)
            for e in entities:
                together[t, e].add(text)
    out, n = {}, len(texts_of_all)
    for (t, e), texts in together.items():
        content, told = math.log(n / len(of[e])), math.log(n * len(texts) / (len(alone[t]) * len(of[e])))
        if len(texts) >= min_texts and content > 0 and told >= share * math.log(n) - 1e-9 and told >= generalise * content - 1e-9:
            out[pii.term(t)] = max(told / content, out.get(pii.term(t), 0))
    return out


ODD_LETTERS = [(30 + k, f"footnote² ½cup Ⅷth naïve Kim_Lee x{k} mail odd@mail.example.org") for k in range(4)] + [(40, "footnote² again, footnote 2"), (41, "Kim² alone")]


@pytest.mark.parametrize("most", [pii.MAX_BROADCAST_TERMS, 0])
def test_terms_are_those_of_brute_force(spark, docs, odd, monkeypatch, most):
    """On both sides of the bound: real texts, odd rows, letters outside ASCII, superscripts, copies."""
    monkeypatch.setattr(pii, "MAX_BROADCAST_TERMS", most)
    data = ODD_LETTERS * 2 + [(100, ODD_LETTERS[0][1])] * 5
    for df, own, share in [(docs, pairs(docs), 0.5), (odd, ODD, 0.2), (frame(spark, data), data, 0.2)]:
        expected = brute_terms(own, share)
        terms = pii.revealing_terms(df, share=share)
        assert {r["term"]: round(r["risk"], 9) for r in terms.collect()} == {t: round(p, 9) for t, p in expected.items()}
        wanted = []
        for i, t in own:
            spans = naive(t)
            taken = [x for v in spans.values() for x in v]
            spans["term"] = [m.span() for m in re.finditer(r"[^\W_]+", t or "") if pii.term(m[0]) in expected and all(m.end() <= a or m.start() >= b for a, b in taken)]
            wanted.append((i, ",".join(f"{k}:{a}:{b}" for k, x in spans.items() for a, b in x)))
        same(pii.personal_data(df, terms), wanted, ["doc_id", "spans"])


def test_revealing_terms(spark, tmp_path):
    """A planted name is found by the registered query, with words that stand nowhere else; words of many texts aren't."""
    names = ["ab", "cd", "ef", "gh"]
    data = [(k, f"t{k} {names[k]} report by Quillfeather reach quill@mail.example.org filler") for k in range(4)]
    data += [(9, "a clean report mentions nobody"), (10, "Quillfeather came"), (11, None), *((20 + k, f"filler report reach w{k}") for k in range(300))]
    df = frame(spark, data * 2)  # copies are no evidence
    terms = pii.revealing_terms(df)
    assert {r["term"]: round(r["risk"], 3) for r in terms.collect()} == {"quillfeather": 0.949, "by": 1.0}
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df, terms).collect()}
    assert out[10] == "[TERM] came" and out[9] == data[4][1] and out[11] is None and out[0] == "t0 ab report  [TERM] reach [EMAIL] filler"
    assert pii.sanitised(df, terms).columns == df.columns
    assert {r["doc_id"]: r["text"] for r in pii.sanitised(df, terms, remove=0.5).collect()}[10] == " came"
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spans = {r["doc_id"]: r["spans"] for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    assert spans[10] == "term:0:12" and spans[0].startswith("email:") and ",term:" in spans[0] and spans[25] == ""


def test_a_shared_footer_reveals_nothing(spark):
    """Texts of one site in a language of its own share an address and all its common words."""
    site = [(k, f"and the shop is open today at number {k} w{k} to write you can reach us via shop@mail.example.org") for k in range(12)]
    assert pii.revealing_terms(frame(spark, site)).count() == 0
    others = [(100 + k, f"le magasin est ferme x{k} jusque demain") for k in range(500)]
    for rows in (site + others, site + others + [(900 + k, f"the {k} and today y{k}") for k in range(400)]):
        terms = pii.revealing_terms(frame(spark, rows))
        assert terms.count() == 0
        assert {r["text"] for r in pii.sanitised(frame(spark, site[:1]), terms).collect()} == {site[0][1].replace("shop@mail.example.org", "[EMAIL]")}


# --- 5


def check_packed(out, data, window=packing.WINDOW, padding=0.2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")) for i, x in data]
    got, sequences = Counter(), defaultdict(list)
    for r in out:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    starts = defaultdict(set)
    for r in out:
        starts[r["doc_id"], r["doc_tokens"]].add((r["start"], r["length"]))
    for i, x in ids:
        cuts = sorted(c for c in starts[i, len(x)])
        for s, n in cuts:
            want[i, s, n, zlib.crc32(x[s : s + n].tobytes()), len(x)] += 1
        assert sum(n for _, n in cuts) == len(x) or len([1 for j, y in ids if (j, len(y)) == (i, len(x))]) > 1
    assert got == want
    total = pad = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
        total += at
        pad += 0 if at & (at - 1) == 0 else window - at
    assert sum(len(x) for _, x in ids) == total
    assert pad <= padding * (total + pad)


def test_packing(docs, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packed(packing.packed(docs, path).collect(), pairs(docs), padding=0.05)
    check_packed(packing.packed(odd, path).collect(), ODD, padding=0.5)
    assert packing.packed(empty, path).count() == 0


def test_tokenizers_of_another_kind(odd):
    """Word by word only where the file's own steps allow it."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = [t for _, t in ODD]
    for name, word_wise in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        own, t = packing.WordIds(path), Tokenizer.from_file(path)
        wanted = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        assert own.word_wise is word_wise and own.batch(pa.array(texts)) == wanted == [own.ids(x) for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 400), min_size=1, max_size=63))
def test_plan(histogram):
    found = Counter()
    for lengths, n in packing.plan(histogram, 64, 4):
        assert n > 0 and 0 < sum(lengths) <= 64
        for x in lengths:
            found[x] += n
    assert found == Counter(histogram)


def test_plan_pads_little():
    rng = np.random.default_rng(0)
    n = Counter(rng.integers(1, 2048, 200_000).tolist())
    found = packing.plan(n)
    total, room = sum(k * v for k, v in n.items()), sum(2048 * m for _, m in found)
    assert total / room > 0.99 and len(found) < 6000


def test_nnls():
    rng = np.random.default_rng(1)
    columns = packing.combinations(np.arange(1, 16), 16)
    target = rng.integers(0, 50, 16).astype(float)
    a = np.zeros((16, len(columns)))
    for k, c in enumerate(columns):
        for x in c[c >= 0]:
            a[x, k] += 1
    x = packing.nnls(columns, target)
    gradient = a.T @ (target - a @ x)
    assert (x >= 0).all() and gradient.max() < 1e-6 and abs(gradient[x > 0]).max() < 1e-6


# --- 7


def brute_fingerprint(text):
    w = words(low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    """prints: (id, fingerprint); ids may be None."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in prints]


NEAR = [(100 + k, LONG[: 4000 + 7 * k]) for k in range(30)] + [(200 + k, COPY + " tail" * (k % 3)) for k in range(9)]


@pytest.mark.parametrize("max_bucket", [near_dedup.MAX_BUCKET, 1])
def test_near_dedup(spark, docs, odd, empty, max_bucket):
    for df, data in [*both(docs, odd), (frame(spark, NEAR + ODD), NEAR + ODD)]:
        expected = brute_components([(i, brute_fingerprint(t)) for i, t in data])
        same(near_dedup.near_dedup(df, max_bucket=max_bucket), expected, ["doc_id", "fingerprint", "component_id"])
    assert near_dedup.near_dedup(empty).count() == 0


@pytest.mark.parametrize("max_bucket", [8, 1000])
def test_links_of_clusters(spark, max_bucket):
    """Chains and balls of fingerprints: the components are those of all pairs at distance 2 or less."""
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(6):
        x = int(rng.integers(0, 2**63))
        for _ in range(60):
            x ^= (1 << int(rng.integers(0, 64))) | (1 << int(rng.integers(0, 64)))
            prints.add(x)
        prints |= {x ^ (1 << b) ^ (1 << c) for b in range(0, 64, 5) for c in range(0, 64, 7)}
    data = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(sorted(prints))]
    df = spark.createDataFrame(data, "doc_id long, fp long")
    nodes = near_dedup.components(near_dedup.links(df, max_bucket))
    named = {r["node"]: r["component"] for r in nodes.collect()}
    groups = defaultdict(set)
    for k, f in data:
        groups[named.get(f, f)].add(k)
    want = defaultdict(set)
    for k, _, c in brute_components(list(enumerate(sorted(prints)))):
        want[c].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_first_of_each(spark, odd):
    out = near_dedup.first_of_each(frame(spark, NEAR + ODD))
    components = {i: c for i, _, c in brute_components([(i, brute_fingerprint(t)) for i, t in NEAR + ODD])}
    found = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in found if x is not None) == sorted({i for i, c in components.items() if i is not None and i == c})
    assert found.count(None) == 1 and out.columns == odd.columns


# --- 8


def test_class_lm(docs, odd, empty):
    for df, data in both(docs, odd):
        counts, held = Counter(), {}
        for i, t in data:
            held[i] = zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
            if not held[i]:
                counts.update([*words(low(t)), "\n"])
        n, v = sum(counts.values()), len(counts)
        expected = []
        for i, t in data:
            tokens = [*words(low(t)), "\n"]
            base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
            expected.append((i, held[i], len(tokens), sum(counts[x] > 0 for x in tokens), n, base))
        for head, clustered in ((class_lm.HEAD_WORDS, 64), (40, 20)):
            out = class_lm.class_lm(df, head, clustered, 8)
            same(out, expected, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"])
            assert out.filter("score is null or score > 0 or isnan(score)").count() == 0
    assert class_lm.class_lm(empty).count() == 0


def test_class_lm_scores_do_not_depend_on_the_head(docs):
    a = class_lm.class_lm(docs, class_lm.HEAD_WORDS, 30, 4)
    b = class_lm.class_lm(docs, 60, 30, 4)  # the head holds the clustered words and few others
    assert rows(a) == rows(b)


@pytest.mark.parametrize("head", [class_lm.HEAD_WORDS, 60])
def test_class_lm_score_is_that_of_its_classes(docs, odd, head):
    """Everything but the choice of classes is counted anew from the texts."""
    for df, data in both(docs, odd):
        of = class_lm.trained(df.select("doc_id", "text"), head, 30, 6)
        k, chosen = of.model.own_classes, {w.decode(): int(c) for (w, _), c in zip(of.model.head, of.model.classes, strict=True)}
        chosen |= {r["word"]: r["class"] for r in of.words.collect()}
        cls = chosen.__getitem__
        tokens = [[*(class_lm.name(w.encode()).decode() for w in words(low(t))), "\n"] for _, t in data]
        counts, steps = Counter(), Counter()
        for (i, _), x in zip(data, tokens, strict=True):
            if zlib.crc32(str("" if i is None else i).encode()) % 10:
                counts.update(x)
                steps.update((cls(a), cls(b)) for a, b in zip(["\n", *x], x, strict=False))
        assert sum(c >= class_lm.LEAST and cls(w) >= k for w, c in counts.items()) == 0  # every frequent word has a class
        total, kinds, into, out = Counter(), Counter(), Counter(), Counter()
        for w, c in counts.items():
            total[cls(w)] += c
            kinds[cls(w)] += 1
        for (a, b), n in steps.items():
            out[a] += n
            into[b] += n
        groups, all_steps = k + class_lm.SHAPES, sum(into.values())
        expected = []
        for (i, _), x in zip(data, tokens, strict=True):
            score = 0.0
            for a, b in zip(["\n", *x], x, strict=False):
                d = cls(b)
                prior = (into[d] + 0.5) / (all_steps + 0.5 * groups)
                score += math.log10((steps[cls(a), d] + class_lm.BACKOFF * prior) / (out[cls(a)] + class_lm.BACKOFF))
                score += math.log10(counts[b] / total[d] if d < k else (counts[b] + class_lm.FLOOR) / (total[d] + class_lm.FLOOR * (kinds[d] + 1)))
            expected.append((i, score))
        same(class_lm.scores(of), expected, ["doc_id", "score"])


def test_head_of_a_flat_vocabulary(spark):
    df = spark.createDataFrame([(f"w{k}", 1, 1) for k in range(500)] + [("\n", 3, 3)], "word string, c long, n long")
    head, others = class_lm.split_head(df, 400)
    assert 350 < len(head) <= 400 and head[0] == (class_lm.END, 3) and len(head) + others.count() == 501


def test_words_of_other_texts_alone(spark):
    """A word that only held-out texts hold, however often, is in the head with no count; texts of several parts
    have the scores that they have under any head."""
    held = next(k for k in range(100) if class_lm.held_out(k))
    rare = " ".join(f"r{k}" for k in range(200_000))
    data = [(held, "zzq " * 400_000 + rare + " end of it"), *((k, f"the end of text {k} is the end") for k in range(100, 160)), (held, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    head, others = class_lm.split_head(class_lm.word_counts(df), 100)
    assert (b"zzq", 0) in head and others.filter("word = 'zzq'").count() == 0
    found = [sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in class_lm.class_lm(df, head_words=n, clustered=4).collect()) for n in (20, class_lm.HEAD_WORDS)]
    assert found[0] == found[1] and max(r[1] for r in found[0]) == 600_004


def test_parts_of_a_text():
    text = "one Two\n\nthree\tfour " * 50
    assert b" ".join(class_lm.parts_of(text, 16)).split() == text.lower().encode().split() and len(class_lm.parts_of(text, 16)) > 10
    assert class_lm.parts_of(None) == [b""] and class_lm.parts_of("A" * 50, 16) == [b"a" * 50]


def test_likeliest_class_is_that_of_the_contexts():
    table = np.array([[0, 90, 10], [5, 0, 95], [80, 10, 10]])
    left, right = np.array([[9, 0, 1], [0, 8, 1], [1, 0, 9.0]]), np.array([[0, 1, 9], [9, 1, 0], [0, 9, 1.0]])
    assert class_lm.likeliest(left, right, table, 3).tolist() == [1, 2, 0]


def test_class_lm_beats_unigrams_on_held_out_texts(docs):
    got = class_lm.class_lm(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert class_lm.perplexity(got["s"], got["n"]) < class_lm.perplexity(got["b"], got["n"])


def test_model_is_a_distribution(docs):
    of = class_lm.trained(docs.select("doc_id", "text"), 500, 50, 6)
    m = of.model
    assert np.allclose((10**m.transition).sum(axis=1), 1)
    total = np.zeros(6 + class_lm.SHAPES)
    np.add.at(total, m.classes, 10**m.emission * np.array([c > 0 for _, c in m.head]))
    for r in of.words.select("word", "c", "class").distinct().filter("c > 0").collect():
        total[r["class"]] += 10 ** float(class_lm.emitted(np.array([r["c"]]), np.array([r["class"]]), m.class_tokens, m.class_words, 6)[0])
    total[6:] += class_lm.FLOOR / (m.class_tokens[6:] + class_lm.FLOOR * (m.class_words[6:] + 1))
    assert np.allclose(total[m.class_words > 0], 1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    truth = np.arange(40) % 4
    step = np.roll(np.eye(4), 1, axis=1) * 0.9 + 0.025
    counts = rng.poisson(200 * step[truth][:, truth])
    cls = class_lm.exchange(counts, 40, 4, 0)
    assert len({(a, b) for a, b in zip(truth, cls, strict=True)}) == 4


# --- 10


MARKS = [(50, "a▁b " * 40), (51, "a b " * 40), (52, "plain words in a row " * 30), (53, " two  spaces and ends "), (54, "▁" * 90)]


def test_sentencepiece(spark, docs, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece_scan.pieces_of(path).sp
    for df, data in [*both(docs, odd), (frame(spark, MARKS), MARKS)]:
        expected = []
        for i, t in data:
            ids = np.array(sp.encode(t) if t else [], "<u4")
            expected.append((i, len(ids), zlib.crc32(ids.tobytes()), sp.decode(ids.tolist()) == (t or "")))
        for giant, chunk in ((sentencepiece_scan.GIANT, sentencepiece_scan.CHUNK), (100, 64)):
            out = sentencepiece_scan.encoded(df, path, "bpe", giant, chunk)
            same(out, expected, ["doc_id", "n_ids", "ids_crc32", "round_trip"])
    assert sentencepiece_scan.encoded(empty, path).count() == 0


def scanned(model, text, chunk, sizes=None):
    s = sentencepiece_scan
    b = s.boundaries(text, chunk)
    spans = list(zip(b, b[1:], strict=False))
    cuts = [(s.is_cut(model, text, a), s.is_cut(model, text, e)) for a, e in spans]
    found = [s.matrix(model, text, a, e, c) for (a, e), c in zip(spans, cuts, strict=True)]
    if sizes is not None:
        sizes += [m.size for _, _, m in found]
    path = s.chosen([m for _, _, m in found])
    ends = [x[k] for (_, x, _), k in zip(found, path[1:], strict=True)]
    return [i for (a, e), c, first, last in zip(spans, cuts, [s.CUT, *ends[:-1]], ends, strict=True) for i in s.backtrace(model, text, a, e, c, first, last).tolist()]


@settings(max_examples=150, deadline=None)
@given(st.text("ab é日😀1tion", min_size=1, max_size=120), st.integers(3, 40))
def test_chunks_give_the_library_s_ids(text, chunk):
    model = sentencepiece_scan.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    assert scanned(model, model.normal(text), chunk) == model.sp.encode(text)
    assert model.decode(model.encode(text)) == text


def test_boundaries_within_words_have_states(docs):
    """Giant texts with spaces, cut as the registered query cuts them: most matrices aren't 1x1."""
    model = sentencepiece_scan.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    text = " ".join(t for _, t in pairs(docs) if t)[: 12 * sentencepiece_scan.CHUNK]
    assert len(text) >= 8 * sentencepiece_scan.CHUNK
    sizes: list[int] = []
    assert scanned(model, model.normal(text), sentencepiece_scan.CHUNK, sizes) == model.sp.encode(text)
    assert sum(n > 1 for n in sizes) > len(sizes) / 2


class Unigram(sentencepiece_scan.Pieces):
    """A small unigram model for the lattice alone."""

    def __init__(self):
        self.kind = "unigram"
        names = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa", "bb", "▁a", "▁"]
        self.ids = {p: k for k, p in enumerate(names)}
        self.scores = {p: -1.0 - 0.173 * k - 0.1 * k % 0.7 for k, p in enumerate(names)}
        self.longest, self.unknown_score, self.pairs, self.words, self.one_word = 3, -20.0, {}, {}, True
        self.prefixes = {p[:k] for p in names for k in range(1, len(p) + 1)}
        self.byte_ids = {k: 100 + k for k in range(256)}

    def best(self, text):
        """(score, ids) by dynamic programming over the whole text."""
        at = {0: (0.0, [])}
        for k in range(1, len(text) + 1):
            options = [(at[k - len(p)][0] + self.scores[p], [*at[k - len(p)][1], self.ids[p]]) for p in self.ids if k >= len(p) and text[k - len(p) : k] == p]
            at[k] = max(options)
        return at[len(text)]


@settings(max_examples=150, deadline=None)
@given(st.text("abc▁", min_size=1, max_size=60), st.integers(2, 20))
def test_unigram_scan_is_viterbi(text, chunk):
    model = Unigram()
    score = {k: s for (p, k), s in zip(model.ids.items(), model.scores.values(), strict=True)}
    assert abs(sum(score[i] for i in scanned(model, text, chunk)) - model.best(text)[0]) < 1e-9


def test_scan_is_associative():
    rng = np.random.default_rng(4)
    sizes = [1, 3, 2, 4, 2, 1]
    m = [rng.normal(size=(a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    one = m[0]
    for x, scanned_ in zip(m[1:], sentencepiece_scan.scan(m)[1:], strict=True):
        one = sentencepiece_scan.times(one, x)
        assert np.allclose(one, scanned_)


@given(st.lists(st.binary(max_size=50), max_size=5))
def test_crc_combined(parts):
    assert sentencepiece_scan.crc_combined((zlib.crc32(p), len(p)) for p in parts) == zlib.crc32(b"".join(parts))
