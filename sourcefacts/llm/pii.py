"""Personal data: patterns, and terms that give protected values away.

Values found by pattern (e-mail, address, card and phone numbers) are the
protected entities. Over all documents of the corpus it is counted in how many
a term stands near an entity, and how many hold the term at all; what
uncertainty about the entity is left to a reader who sees the term is then
``-log2 P(entity | term)`` bits. Terms that leave too little are generalised,
those that leave less are removed. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tables import drop_tables, written_tables
from .common import materialize, running_totals

#: The patterns of the contract. Quantifiers that can never give
#: back are possessive, and a match may begin only where a run begins or the
#: last match ended, so that long runs are read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
TERM_KIND = "term"

WORD = r"\p{N}*+\p{L}[\p{L}\p{N}]*+"
#: Code points on either side of a value whose words are taken to stand near it.
CONTEXT = 160
#: So many more documents are taken to hold a term without the entity, so that
#: P(entity | term) is the smaller the less was seen; one certain link leaves one bit.
UNSEEN_DOCS = 1
#: Bits of uncertainty about the entity below which a term is generalised, or removed.
GENERALISE_BITS = 2.0
REMOVE_BITS = 1.0

SPAN = "struct<kind:int,start:int,end:int,value:string,action:string>"


def _found(text: Column, pattern: Column | str) -> Column:
    return F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))


def located(text: Column, pattern: Column | str, values: Column, kind: int, action: Column | str = "") -> Column:
    """Spans in code points of all matches, from the text between them."""
    gaps = F.split(text, pattern, -1)
    advances = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda gap, v: F.length(gap) + F.length(v))
    label = F.lit(action) if isinstance(action, str) else action
    spans = F.zip_with(
        values, running_totals(advances),
        lambda v, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value"), label.alias("action")),
    )
    return F.when(F.size(values) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def digit(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + digit(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        size = F.length(_digits(value))
        return F.when((size >= 16) & (size <= 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _holding(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _matches(docs: DataFrame) -> DataFrame:
    """Adds ``_m_<kind>``: all matches of each pattern in ``_text``."""
    text = F.col("_text")
    needs = {"email": text.contains("@"), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    none = F.array().cast("array<string>")
    return docs.select("*", *[F.when(needs[k], _found(text, PATTERNS[k])).otherwise(none).alias(f"_m_{k}") for k in KINDS])


def _any_match() -> Column:
    return F.size("_m_email") + F.size("_m_ip") + F.size("_m_card") + F.size("_m_phone") > 0


def find_values(docs: DataFrame) -> DataFrame:
    """Adds ``_spans``: the pattern matches of ``_text`` that hold, by kind and start.

    ``_text`` must not be null. Matches of one kind don't overlap; one that
    fails its test is dropped and nothing else is tried in its place.
    """
    parts = [_holding(located(F.col("_text"), PATTERNS[k], F.col(f"_m_{k}"), i), k) for i, k in enumerate(KINDS)]
    spans = F.when(_any_match(), F.concat(*parts)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return _matches(docs).select("*", spans.alias("_spans")).drop(*[f"_m_{k}" for k in KINDS])


def _identity(kind: str, value: Column) -> Column:
    """Values that are one entity: an e-mail in any case, a number however it is spaced."""
    return F.lower(value) if kind in ("email", "ip") else F.concat(F.lit(f"{kind} "), _digits(value))


def _words(text: Column) -> Column:
    """Lower-cased words of a text, what looks like a value left out."""
    blank = F.regexp_replace(text, "|".join(PATTERNS.values()), " ")
    return _found(F.lower(F.when(text.rlike("[0-9@]"), blank).otherwise(text)), WORD)


def _near(before: Column, after: Column) -> Column:
    """Distinct whole words of the last and first ``CONTEXT`` code points of two texts."""
    left = F.when(F.length(before) > CONTEXT, F.regexp_replace(F.right(before, F.lit(CONTEXT)), r"^[\p{L}\p{N}]+", "")).otherwise(before)
    right = F.when(F.length(after) > CONTEXT, F.regexp_replace(F.left(after, F.lit(CONTEXT)), r"[\p{L}\p{N}]+$", "")).otherwise(after)
    return F.array_distinct(_words(F.concat(left, F.lit(" "), right)))


def entity_terms(docs: DataFrame) -> DataFrame:
    """``entity, term, n_both``: documents of ``_text`` in which the term stands near the entity.

    Near is: in the text between the value and the matches of its kind beside
    it, at most ``CONTEXT`` code points away. So a value has a bounded number
    of terms, however long the text.
    """
    text = F.col("_text")

    def of_kind(kind: str) -> Column:
        gaps = F.split(text, PATTERNS[kind], -1)
        sides = F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("before"), F.slice(gaps, 2, F.size(gaps) - 1).alias("after"), F.col(f"_m_{kind}").alias("value"))
        return F.transform(
            F.filter(sides, lambda z: _valid(kind, z["value"])),
            lambda z: F.transform(_near(z["before"], z["after"]), lambda term: F.concat(_identity(kind, z["value"]), F.lit("\n"), term)),
        )

    # no value and no term holds a newline, so a pair is one string, which can be told apart by hash
    pairs = F.array_distinct(F.flatten(F.concat(*[F.when(F.size(f"_m_{k}") > 0, of_kind(k)).otherwise(F.array().cast("array<array<string>>")) for k in KINDS])))
    counted = _matches(docs).where(_any_match()).select(F.explode(pairs).alias("_pair")).groupBy("_pair").agg(F.count("*").alias("n_both"))
    at = F.split("_pair", "\n")
    return counted.select(at[0].alias("entity"), at[1].alias("term"), "n_both")


def term_counts(docs: DataFrame) -> DataFrame:
    """``_term, n_docs``: documents that hold each term, named by a 64-bit hash; copies count like any other document."""
    hashes = F.transform(F.array_distinct(_words(F.col("_text"))), lambda w: F.xxhash64(w))
    return docs.select(F.explode(hashes).alias("_term")).groupBy("_term").agg(F.count("*").alias("n_docs"))


def disclosing_terms(pairs: DataFrame, counts: DataFrame, generalise_bits: float = GENERALISE_BITS, remove_bits: float = REMOVE_BITS) -> DataFrame:
    """``entity, term, n_both, n_docs, bits, action`` for terms above the disclosure threshold.

    ``pairs`` are the ``entity_terms``, ``counts`` the ``term_counts`` of the
    corpus. Every pair is measured, however rare the entity or the term.
    """
    bits = -F.log2(F.col("n_both") / (F.col("n_docs") + UNSEEN_DOCS))
    return (
        pairs.withColumn("_term", F.xxhash64("term")).join(counts, "_term").select("entity", "term", "n_both", "n_docs", bits.alias("bits"))
        .where(F.col("bits") <= generalise_bits)
        .withColumn("action", F.when(F.col("bits") <= remove_bits, "remove").otherwise("generalise"))
    )


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def marked_terms(docs: DataFrame, flagged: DataFrame, everywhere: bool) -> DataFrame:
    """``_key, _terms``: for texts (by hash) that hold flagged terms, these with their actions.

    A text that holds an entity: the entity's terms. With ``everywhere`` any
    text: terms of which at least one entity is the likelier reading, so that
    at most ``REMOVE_BITS`` are left. Where a term has several actions the
    stricter holds.
    """
    values = find_values(docs)
    held = values.where(F.size("_spans") > 0).select(_key(F.col("_text")).alias("_key"), "_text", "_spans")
    names = F.transform("_spans", lambda s: F.coalesce(*[F.when(s["kind"] == i, _identity(k, s["value"])) for i, k in enumerate(KINDS)]))
    entities = held.select("_key", F.explode(F.array_distinct(names)).alias("entity")).distinct()
    terms = held.select("_key", F.explode(F.array_distinct(_words(F.col("_text")))).alias("term")).distinct()
    # terms first, as few of them are flagged; then only those of the text's own entities
    listed = terms.join(flagged.select("entity", "term", "action").hint("merge"), "term").join(entities, ["_key", "entity"], "left_semi").select("_key", "term", "action")
    if everywhere:
        # only terms that stand in other documents, too
        certain = flagged.where((F.col("action") == "remove") & (F.col("n_docs") > F.col("n_both"))).select("term").distinct()
        certain = materialize(certain, "certain-terms")
        words = docs.select(_key(F.col("_text")).alias("_key"), F.explode(F.array_distinct(_words(F.col("_text")))).alias("term"))
        listed = listed.unionByName(words.join(certain, "term").select("_key", "term", F.lit("remove").alias("action")))
    # "remove" sorts last
    strictest = listed.groupBy("_key", "term").agg(F.max("action").alias("action"))
    return strictest.groupBy("_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "action")))).alias("_terms"))


def find_disclosures(docs: DataFrame, payload: list[str], text_col: str = "text", everywhere: bool = False) -> DataFrame:
    """``_row`` (struct of ``payload``) with ``text``, ``absent`` (it was null) and ``spans`` of every row.

    ``spans`` (array of kind, start, end, value, action) has the pattern
    matches by kind and start, then the disclosing terms by start; a term that
    overlaps a pattern match is part of it. Terms are marked in documents that
    hold the entity; with ``everywhere`` those that leave at most
    ``REMOVE_BITS`` are marked in all documents. A null text is empty. Rows may
    repeat, ids are not looked at, and copies of a text get the same spans; a
    term with two actions takes the stricter; an empty table gives no rows.
    The table is read once for each count, so no text is written; it meets the
    marked terms by the hash of its text, in a join by shuffle at every size.
    Leave the text out of ``payload``, else it goes through that shuffle twice.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in payload]).alias("_row")
    told = F.col(f"`{text_col}`").cast("string")
    whole, absent = F.coalesce(told, F.lit("")).alias("_text"), told.isNull().alias("_absent")
    texts = docs.select(whole)
    with written_tables() as on_the_way:
        pairs = materialize(entity_terms(texts), "entity-terms")
        flagged = materialize(disclosing_terms(pairs, term_counts(texts)), "disclosing-terms")
        terms = marked_terms(texts, flagged, everywhere)
    marks = materialize(terms, "marked-terms")
    drop_tables(docs.sparkSession, on_the_way)
    found = find_values(docs.select(row, whole, absent)).withColumn("_key", _key(F.col("_text"))).join(marks.hint("merge"), "_key", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.map_keys("_terms"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    marked = found.withColumn("_pattern", pattern).withColumn("_hits", F.when(F.col("_terms").isNotNull(), _found(F.col("_text"), F.col("_pattern"))).otherwise(F.array().cast("array<string>")))
    spots = F.when(F.size("_hits") > 0, located(F.col("_text"), F.col("_pattern"), F.col("_hits"), len(KINDS))).otherwise(F.array().cast(f"array<{SPAN}>"))
    marked = marked.withColumn("_spots", spots)
    free = F.filter("_spots", lambda w: ~F.exists("_spans", lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"])))
    acted = F.transform(free, lambda w: w.withField("action", F.coalesce(F.try_element_at(F.col("_terms"), F.lower(w["value"])), F.lit("generalise"))))
    return marked.select("_row", F.col("_text").alias("text"), F.col("_absent").alias("absent"), F.concat("_spans", acted).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with values and disclosing terms replaced.

    Values become the name of their kind; terms become a general word or go.
    Where spans overlap, the one that begins first counts.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["action"].alias("action"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM_KIND)])
    done = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.when(s["action"] == "remove", "").otherwise(F.get(names, s["kind"]))).alias("out"),
            )
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def sanitise(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in ``text``.

    A null text stays null; ``n_chars``, where there is one, follows the text.
    ``everywhere`` as in ``find_disclosures``.
    """
    kinds = dict(docs.dtypes)
    out = find_disclosures(docs, [c for c in docs.columns if c != "text"], everywhere=everywhere)
    changed = F.size("spans") > 0
    done = out.withColumn("_done", F.when(changed, redact(F.col("text"), F.col("spans"))).when(~F.col("absent"), F.col("text")))
    columns = {c: F.col("_done") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns}
    if "n_chars" in kinds:
        columns["n_chars"] = F.when(changed, F.length("_done").cast(kinds["n_chars"])).otherwise(F.col("_row.n_chars"))
    return done.select(*[v.alias(c) for c, v in columns.items()])


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts, spans and their digest for every document; terms are marked everywhere."""
    out = find_disclosures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], everywhere=True)
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM_KIND)])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return out.select(
        F.col("_row.doc_id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"),
    )
