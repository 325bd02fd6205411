"""4. Personal data: patterns, then information-theoretic sanitisation.

Base spans are what four patterns match. They are the protected entities. Over the whole corpus of N distinct
texts the method counts in how many an entity stands, n(e), a term, n(t), and both, n(t, e). Terms are whole
runs of letters and digits, of any length, that no base span touches. In bits,

    IC(e) = log N / n(e)            what naming the entity tells
    PMI(e; t) = log N n(t, e) / (n(t) n(e))            what the term tells of it; at most IC(e) and IC(t)

and the term's risk is PMI(e; t) / IC(e): 1 if the term gives the entity away, 0 if it tells nothing of it. A term
seen with one entity in at least min_texts texts is a span of kind "term" if its risk is `generalise` or more
and PMI(e; t) is at least `share` of log N, what it takes to single out one text. So neither words of more
than N^(1 - share) texts are terms, whatever they stand with, nor is the address in a footer of so many texts
protected: its prior leaves too little to disclose. sanitised() writes a placeholder for a term, and drops
it at or over `remove`. Counts are of distinct texts, so copies of a text are no evidence.

Defined results: a null text is empty and stays null when sanitised; repeated rows have the spans of each; an
empty table gives no rows and no terms; very long texts are read whole, one at a time, and terms and entities
of over 64 characters are counted by their digests; a term of equal risks for two entities is one term; spans
of one kind don't overlap, spans of two kinds may, and the union of overlapping spans is replaced by the
first one's placeholder; extra columns don't matter, and stay in sanitised().
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import A_TO_Z, batches_of, joined_by_group, narrow, rows_of, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\W_]+")
#: What 13 to 19 digits, perhaps parted by single spaces or hyphens, must begin with.
CARD_HINT = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")
#: Flagged or candidate terms, or entities, up to this many go to the workers as one set; more are joined.
MAX_BROADCAST_TERMS = 200_000
LONGEST_TERM = 64
#: Keys of texts that a task holds before it puts them out.
MAX_HELD = 1_000_000
MIN_TEXTS, GENERALISE, REMOVE, SHARE = 3, 0.9, 0.98, 0.7

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain. The local part is the longest run of its characters before
    an @, so runs without an @ are never searched again and again."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, end := m.end()))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def part_fits(part: str) -> bool:
    return len(kept := part.lstrip("0")) <= 3 and int(kept or 0) <= 255


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> dict[str, list[Span]]:
    """Spans of each kind; a match that fails its check is dropped without another try."""
    if not text:
        return {k: [] for k in KINDS}
    return {
        "email": emails(text),
        "ip": [m.span() for m in IP.finditer(text) if all(map(part_fits, m[0].split(".")))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(n := digits(m[0])) <= 19 and luhn(n)] if CARD_HINT.search(text) else [],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


def entity(kind: str, found: str) -> str:
    """One name for the spellings of an entity."""
    return f"{kind}:{found.lower() if kind in ('email', 'ip') else digits(found)}"


def lower_ascii(x: str) -> str:
    return x.encode().translate(A_TO_Z).decode()


def term(token: str) -> str:
    """The name of a token: in lower case; one of over LONGEST_TERM characters by its digest, so names are bounded."""
    low = lower_ascii(token)
    return low if len(low) <= LONGEST_TERM else "#" + hashlib.sha256(low.encode()).hexdigest()


def term_spans(text: str, spans: Iterable[Span] = ()) -> list[Span]:
    """Whole runs of letters and digits that no span touches."""
    taken, last = [], 0
    for s, e in sorted(spans):  # united, so one cursor is enough
        if e > last:
            taken.append((max(s, last), e))
            last = e
    out, k = [], 0
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            out.append((s, e))
    return out


def terms_of(text: str, spans: dict[str, list[Span]]) -> set[str]:
    return {term(text[a:b]) for a, b in term_spans(text, (s for k in KINDS for s in spans[k]))}


def entities_of(text: str, spans: dict[str, list[Span]]) -> set[str]:
    """Over LONGEST_TERM characters by their digests."""
    names = {entity(kind, text[s:e]) for kind in KINDS for s, e in spans[kind]}
    return {x if len(x) <= LONGEST_TERM else "#" + hashlib.sha256(x.encode()).hexdigest() for x in names}


def _few(table: DataFrame, column: str) -> frozenset[str] | None:
    """The column's values if they are few enough for one set."""
    if table.limit(MAX_BROADCAST_TERMS + 1).count() > MAX_BROADCAST_TERMS:
        return None
    return frozenset(r[column] for r in table.select(column).collect())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return narrow(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")


def revealing_terms(docs: DataFrame, min_texts: int = MIN_TEXTS, generalise: float = GENERALISE, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, risk: the terms over the disclosure thresholds, with their largest risk, over all documents."""
    spark = docs.sparkSession
    own = _texts(docs, id_col, text_col).select("text", F.xxhash64("text").alias("key"))

    def mentions(batches):
        rows = ((e, key) for text, key in rows_of(batches) if text for e in entities_of(text, base_spans(text)))
        return batches_of(rows, pa.schema([("entity", pa.string()), ("key", pa.int64())]))

    total = own.filter("length(text) > 0").select("key").distinct().count()
    least = share * math.log(max(total, 1))  # of PMI, in nats as all below
    # an entity of fewer texts can't stand with a term in min_texts of them, nor one of more be told by any term
    often = own.mapInArrow(mentions, "entity string, key long").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= min_texts) & (F.col("n") < total) & (F.log(total / F.col("n")) >= least - 1e-9))
    often = written(spark, often, "pii-entities")
    named = _few(often, "entity")
    sent_names = None if named is None else spark.sparkContext.broadcast(named)

    def pairs(batches):
        wanted = sent_names.value if sent_names else None

        def rows():
            for text, key in rows_of(batches):
                if text and any((spans := base_spans(text)).values()):
                    found = entities_of(text, spans)
                    if wanted is not None:
                        found &= wanted
                    if found:
                        for t in terms_of(text, spans):
                            yield from ((t, e, key) for e in found)

        return batches_of(rows(), pa.schema([("term", pa.string()), ("entity", pa.string()), ("key", pa.int64())]))

    seen = own.mapInArrow(pairs, "term string, entity string, key long")
    seen = written(spark, (seen if named is not None else joined_by_group(seen, often, "entity", docs.count()).select(*seen.columns)).distinct(), "pii-pairs")
    together = seen.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= min_texts)
    # a term stands in at least the texts where it stands with any entity, so most terms need no further count
    near_any = seen.groupBy("term").agg(F.countDistinct("key").alias("near_any"))
    content = F.log(total / F.col("n"))
    pmi = lambda texts: F.log(total * F.col("together") / (F.col(texts) * F.col("n")))
    told = lambda texts: (pmi(texts) >= least - 1e-9) & (pmi(texts) >= generalise * content - 1e-9)
    together = together.join(near_any, "term").join(often, "entity").filter(told("near_any")).select("term", "entity", "together", "n")
    together = written(spark, together, "pii-together")
    terms = together.groupBy("term").agg(F.max("together").alias("n"))  # n: for joined_by_group
    candidates = _few(terms, "term")
    sent = None if candidates is None else spark.sparkContext.broadcast(candidates)

    # a term of more texts tells too little of anything, so one task's first limit + 1 texts prove that it's none
    limit = math.floor(max(total, 1) * math.exp(-least) * (1 + 1e-9))

    def standing(batches):
        wanted = sent.value if sent else None

        def rows():
            if wanted is not None and not wanted:
                return
            texts, held, n = set(), {}, 0
            for text, key in rows_of(batches):
                if text and key not in texts and (wanted is None or not wanted.isdisjoint(map(term, TOKEN.findall(text)))):
                    texts.add(key)
                    has = terms_of(text, base_spans(text))
                    for t in has if wanted is None else wanted & has:
                        if len(own := held.setdefault(t, [])) <= limit:
                            own.append(key)
                            n += 1
                    if n > MAX_HELD:
                        yield from held.items()
                        held, n = {}, 0
            yield from held.items()

        return batches_of(rows(), pa.schema([("term", pa.string()), ("keys", pa.list_(pa.int64()))]), 1024)

    def merged(batches):
        """The texts of each term, rows of a term standing together; of those over the limit no more than that they are."""

        def rows():
            now, keys = None, set()
            for t, own in rows_of(batches):
                if t != now:
                    if now is not None:
                        yield now, len(keys)
                    now, keys = t, set()
                if len(keys) <= limit:
                    keys.update(own)
            if now is not None:
                yield now, len(keys)

        return batches_of(rows(), pa.schema([("term", pa.string()), ("alone", pa.int64())]))

    stands = own.mapInArrow(standing, "term string, keys array<long>")
    stands = stands if sent else joined_by_group(stands, terms, "term", docs.count())
    alone = stands.repartition("term").sortWithinPartitions("term").mapInArrow(merged, "term string, alone long")
    return together.join(alone, "term").filter(told("alone")).groupBy("term").agg(F.max(pmi("alone") / content).alias("risk"))


def _with_terms(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str):
    """docs with a column of each text's revealing terms (term, risk) where they are too many for one
    set, else None; and the set."""
    spark = docs.sparkSession
    terms = written(spark, terms, "pii-terms")
    if terms.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS:
        return None, spark.sparkContext.broadcast({r["term"]: r["risk"] for r in terms.collect()})
    keyed = docs.withColumn("__key", F.xxhash64(F.col(f"`{text_col}`").cast("string")))

    def tokens(batches):
        rows = ((key, t) for key, text in rows_of(batches) if text for t in {term(x) for x in TOKEN.findall(text)})
        return batches_of(rows, pa.schema([("__key", pa.int64()), ("term", pa.string())]))

    has = keyed.select("__key", F.col(f"`{text_col}`").cast("string")).mapInArrow(tokens, "__key long, term string")
    found = has.distinct().join(terms, "term").groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("term", "risk"))).alias("__terms"))
    sizes = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    return joined_by_group(keyed, sizes.join(found, "__key", "left"), "__key", docs.count()).select(*docs.columns, "__terms"), None


def spans_of(text: str | None, terms: dict[str, float]) -> dict[str, list[Span]]:
    spans = base_spans(text)
    spans["term"] = []
    if text and terms and not terms.keys().isdisjoint(map(term, TOKEN.findall(text))):
        free = term_spans(text, (s for k in KINDS for s in spans[k]))
        spans["term"] = [(s, e) for s, e in free if term(text[s:e]) in terms]
    return spans


def sanitise(text: str | None, terms: dict[str, float], remove: float = REMOVE) -> str | None:
    """The text with a placeholder for each span; a term at or over `remove` goes without one."""
    if text is None:
        return None
    spans = sorted((s, e, k) for k, x in spans_of(text, terms).items() for s, e in x)
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            gone = kind == "term" and terms[term(text[s:e])] >= remove
            out += [text[at:s], "" if gone else f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, x in spans.items() for s, e in sorted(x))


def personal_data(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (base ones and terms) of every row."""
    own = _texts(docs, id_col, text_col)
    wide, sent = _with_terms(own, terms, "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text, *more in rows_of(batches):
                spans = spans_of(text, sent.value if sent else dict(more[0] or ()))
                base = joined({k: spans[k] for k in KINDS})
                yield doc_id, *(len(spans[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans)

        return batches_of(rows(), schema)

    return (own if wide is None else wide).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitised(docs: DataFrame, terms: DataFrame, remove: float = REMOVE, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with sanitised texts (and their lengths), in one pass; all columns and rows stay."""
    wide, sent = _with_terms(docs, terms, id_col, text_col)
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(chars_col) if chars_col in docs.columns else None
    width = len(docs.columns)

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            more = None if sent else batch.column(width)
            new = [sanitise(texts[i].as_py(), sent.value if sent else dict(more[i].as_py() or ()), remove) for i in range(batch.num_rows)]
            columns = list(batch.columns[:width])
            columns[at] = pa.array(new, pa.string())
            if length_at is not None:
                columns[length_at] = pa.array([None if x is None else len(x) for x in new], batch.column(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    return (docs if wide is None else wide).mapInArrow(run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return personal_data(docs, revealing_terms(docs))
