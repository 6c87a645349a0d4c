"""Personal data and what reveals it, by information-theoretic sanitisation, with DataFrame operations only.

Protected entities are emails, IP addresses, card and phone numbers in whole texts, and secrets that a text assigns to a name such as
``token``. The entities of a document together are its record; documents with the same entities have the same record, so a record stands
for whom or what they are about. Every term (word of three letters or more) of the whole text is held against the record. With N documents, df(r) and
df(t) those that have the record and the term, and co(r, t) those that have both, all counted over the whole corpus:

    information of the record   IC(r)     = log2(N / df(r))
    share of the term's         p(r | t)  = co(r, t) / (df(t) + SMOOTHING)
    what the term reveals       PMI(r, t) = log2(p(r | t) * N / df(r))

What it leaves unknown is IC - PMI = -log2 p(r | t). A term that leaves a tenth of the record's information or less, or no more than one bit (but at most
a quarter), is generalised in the record's documents; one that leaves no more than REMOVE of that is removed. The smoothing is what a term of few
documents lacks in evidence: one that stands in a single document leaves one bit. Words that many documents use reveal little of a record, however
often they stand beside an entity. Documents without an entity have no record and stay as they are.

An entity that stands in documents with different other entities is part of several records, and what a term reveals of it is dealt out over them: a name
that always stands beside one email tells little of any record if each document has a phone number of its own. With ``each``, terms are
therefore held against every entity of their document as well, by the same counts and limits, df(r) and co(r, t) being of the entity; a term goes by the
strictest that it meets. An entity of a single record has that record's counts, and entities of the same records have the same counts, so only
sets of entities that several records have in common are counted besides.

A record of many such sets and many terms is not multiplied out. Where terms times sets are more than LARGE times their sum, the record is a large one. Sets
that have the same large records have the same counts in them, so these are counted once for all such sets, under the fewest documents that any of them has; only small
records meet each of their sets. A term that stands beside a set in large records alone reveals most of the set of the fewest documents, which stands
in the same large records; for any other, the two counts are added up. So the result is that of holding every term against every entity.

Matches come with the texts between them (the same pattern splits the text), whose lengths add up to offsets in code points.
The patterns are the contract's with possessive repeats and starts only where a run begins or a match has ended; they match the
same strings in time linear in the text.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, stored

SMOOTHING = 1.0
#: Parts of a record's information that a term may leave unknown and yet is generalised: at most, and at least if that is more than BIT.
QUARTER, TENTH, BIT = 0.25, 0.1, 1.0
#: The part of that up to which it is removed.
REMOVE = 0.6
#: A record is large where terms times sets of entities are more than this times their sum.
LARGE = 16
#: The kinds that a document's counts and digest are of, by their numbers.
KINDS = ("email", "ip", "card", "phone")
#: Numbers of the kinds that the method adds: secrets, and terms to generalise or to remove.
SECRET, TO_GENERALISE, TO_REMOVE = range(4, 7)
_E = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_E})){_E}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"""(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Aa]pi_?[Kk]ey|API_?KEY|[Aa]ccess_?[Kk]ey|ACCESS_?KEY)["']?[ ]?[=:][ ]?["']?[A-Za-z0-9_/+.=-]{16,}+""",
}
TERM = r"\p{L}{3,}+"


def _gate(kind: str, text: Column) -> Column:
    """False only where the kind cannot match."""
    return {
        "email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), "phone": text.contains("+"), "secret": text.rlike(r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Kk]ey|KEY)[\"']?[ ]?[=:]"),
    }[kind]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    short = lambda x: F.regexp_replace(x, "^0+", "")
    ip = F.forall(F.split(value, r"\."), lambda x: (F.length(short(x)) <= 3) & (F.coalesce(short(x).try_cast("int"), F.lit(0)) <= 255))
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    luhn = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), lambda i: F.struct((i - 1).alias("i"), F.substring(F.reverse(digits), i, F.lit(1)).try_cast("int").alias("d"))),
        F.lit(0), lambda s, x: s + doubled(x["d"], x["i"]),
    ) % 10 == 0
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", ip)
        .when(kind == "card", F.length(digits).between(12, 19) & luhn)
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(F.lit(True))
    )


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a document: uid, doc_id, key, for each kind the matches and the lengths between them, and the text if it may have any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    out = [F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), F.xxhash64("text").alias("key")]
    for kind, pattern in PATTERNS.items():
        gate = _gate(kind, F.col("text"))
        out.append(F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"m_{kind}"))
        out.append(F.when(gate, F.transform(F.split("text", pattern, -1), lambda g: F.length(g))).alias(f"g_{kind}"))
    some = F.greatest(*[F.coalesce(F.size(f"m_{kind}"), F.lit(0)) for kind in PATTERNS]) > 0
    return rows.select(*out, "text").withColumn("text", F.when(some, F.col("text")))


def base_spans(light: DataFrame) -> DataFrame:
    """(uid, doc_id, key, kind_no, kind, value, start, end) of the valid matches."""
    found = None
    for no, kind in enumerate(PATTERNS):
        m, g = F.col(f"m_{kind}"), F.col(f"g_{kind}")
        each = F.zip_with(m, F.slice(g, 1, F.size(m)), lambda v, n: F.struct(v.alias("value"), n.alias("gap")))
        rows = light.where(F.size(m) > 0).select("uid", "doc_id", "key", F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), F.posexplode(each).alias("pos", "x")).select("uid", "doc_id", "key", "kind_no", "kind", "pos", "x.*")
        found = rows if found is None else found.union(rows)
    to_here = Window.partitionBy("uid", "kind_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(to_here)
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return placed.where(_valid(F.col("kind"), F.col("value"))).select("uid", "doc_id", "key", "kind_no", "kind", "value", "start", "end")


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w))


def _entity() -> Column:
    return F.concat_ws(":", "kind", F.when(F.col("kind") == "email", F.lower("value")).when(F.col("kind").isin("ip", "secret"), F.col("value")).otherwise(_digits(F.col("value"))))


def records(base: DataFrame) -> DataFrame:
    """(u, record, df): the entities of each document that has any, together, and the number of documents that have the same."""
    one = base.groupBy(F.col("uid").alias("u")).agg(F.xxhash64(F.array_sort(F.collect_set(_entity()))).alias("record"))
    return one.join(one.groupBy("record").agg(F.count(F.lit(1)).alias("df")), "record").select("u", "record", "df")


def in_common(base: DataFrame, known: DataFrame) -> DataFrame:
    """(record, df, subject): the entities that more than one record has, one subject for all entities of the same records."""
    members = base.join(known, F.col("uid") == F.col("u")).select("record", "df", F.xxhash64(_entity()).alias("entity")).distinct()
    same = members.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("record")).alias("x"), F.bit_xor(F.xxhash64("record", F.lit(1))).alias("y")).where("n > 1")
    one = same.groupBy("n", "x", "y").agg(F.min("entity").alias("subject")).select("subject")
    return members.join(one, F.col("entity") == F.col("subject")).select("record", "df", "subject")


def beside(pairs: DataFrame, common: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The terms of ``pairs`` (record, term, co) beside the subjects of ``common``, whose large records are not multiplied out.

    First (record, term, co, subject, df, head) of the small records. Then (record, term, co, head, df) of the large ones, where a head stands for all subjects
    with the same large records, and df is the least of theirs. df are documents of a subject, its head is null if it has no large record."""
    size = common.groupBy("record").agg(F.count(F.lit(1)).cast("double").alias("k")).join(pairs.groupBy("record").agg(F.count(F.lit(1)).cast("double").alias("t")), "record")
    links = cut(common.join(size.select("record", (F.col("k") * F.col("t") > LARGE * (F.col("k") + F.col("t"))).alias("large")), "record"))
    of_large = lambda *x: F.when(F.col("large"), F.xxhash64("record", *x))
    n, x, y = F.count(of_large()), F.bit_xor(of_large()), F.bit_xor(of_large(F.lit(1)))
    # records without a term have no pairs, but count among a subject's documents
    subjects = common.groupBy("subject").agg(F.sum("df").alias("df")).join(links.groupBy("subject").agg(F.when(n > 0, F.xxhash64(n, x, y)).alias("head")), "subject")
    subjects = cut(subjects)
    small = links.where("NOT large").select("record", "subject").join(subjects, "subject")
    heads = subjects.where("head IS NOT NULL").groupBy("head").agg(F.min("subject").alias("subject"), F.min("df").alias("df"))
    large = links.where("large").select("record", "subject").join(heads, "subject").drop("subject")
    return stored(pairs.join(small, "record"), "small"), stored(pairs.join(large, "record"), "large")


def occurrences(light: DataFrame, known: DataFrame) -> DataFrame:
    """(uid, doc_id, key, record, term, start, end) of every term of the documents that have a record, with what else ``known`` says of it."""
    more = [c for c in known.columns if c not in ("u", "record")]
    held = light.where("text is not null").select("uid", "doc_id", "key", "text").join(known, F.col("uid") == F.col("u"))
    gaps = F.transform(F.split("text", TERM, -1), lambda g: F.length(g))
    words = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    each = held.select("uid", "doc_id", "key", "record", *more, F.posexplode(F.arrays_zip(words.alias("word"), gaps.alias("gap"))).alias("pos", "x")).select("uid", "doc_id", "key", "record", *more, "pos", "x.word", "x.gap").where("word is not null")
    size = F.length("word")
    end = F.sum(F.col("gap") + size).over(Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return each.withColumn("end", end).select("uid", "doc_id", "key", "record", *more, F.lower("word").alias("term"), (F.col("end") - size).alias("start"), "end")


def revealing(docs: DataFrame, light: DataFrame, base: DataFrame, text_col: str, each: bool = False) -> DataFrame:
    """(uid, doc_id, key, kind_no, kind, value, start, end): terms that reveal too much of their document's record or, with ``each``, of one of its entities."""
    known = cut(records(base))
    common = cut(in_common(base, known)) if each else None
    each = common is not None and not common.isEmpty()
    if each:  # which records have something in common goes with their terms, so that the others' are not looked at again
        known = cut(known.join(common.select("record", F.lit(True).alias("shared")).distinct(), "record", "left").select("u", "record", "df", F.coalesce("shared", F.lit(False)).alias("shared")))
    near = stored(occurrences(light, known), "terms")
    count = lambda rows: rows.select("uid", "record", "df", "term").distinct().groupBy("record", "df", "term").agg(F.count(F.lit(1)).alias("co"))
    none = F.lit(None).cast("long")
    joint = count(near).select(F.lit("record").alias("of"), F.col("record").alias("subject"), "df", none.alias("head"), "term", "co")
    if each:
        # a document has one record, so the counts of what records have in common are sums of theirs
        small, large = beside(stored(count(near.where("shared")).drop("df"), "pairs"), common)
        of_head = large.groupBy("head", "df", "term").agg(F.sum("co").alias("co"))
        more = of_head.select("head", "term", F.col("co").alias("more"))
        of_subject = small.groupBy("subject", "df", "head", "term").agg(F.sum("co").alias("co")).join(more, ["head", "term"], "left").withColumn("co", F.col("co") + F.coalesce("more", F.lit(0)))
        joint = joint.union(of_subject.select(F.lit("subject"), "subject", "df", "head", "term", "co")).union(of_head.select(F.lit("head"), none, "df", "head", "term", "co"))
    of_term = docs.select(F.explode(F.array_distinct(_terms(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    total = F.lit(float(light.count()))
    ic = F.log2(total / F.col("df"))
    told = joint.join(of_term, "term").select(
        "of", "subject", "head", "term", F.least(QUARTER * ic, F.greatest(F.lit(BIT), TENTH * ic)).alias("most"), F.log2((F.col("df_t") + SMOOTHING) / F.col("co")).alias("unknown"), (ic > 0).alias("some")
    )
    chosen = told.where("some AND unknown <= most").select("of", "subject", "head", "term", (F.col("unknown") <= REMOVE * F.col("most")).alias("remove"))
    of_record = lambda rows: rows.where("of = 'record'").select(F.col("subject").alias("record"), "term", "remove")
    strictest = F.bool_or("remove").alias("remove")
    if each:
        chosen = cut(chosen)
        in_small = small.join(chosen.where("of = 'subject'").select("subject", "term", "remove"), ["subject", "term"])
        in_large = large.join(chosen.where("head IS NOT NULL").groupBy("head", "term").agg(strictest), ["head", "term"])
        kept = ["record", "term", "remove"]
        chosen = of_record(chosen).union(in_small.select(kept)).union(in_large.select(kept)).groupBy("record", "term").agg(strictest)
    else:
        chosen = of_record(chosen)
    return near.join(cut(chosen), ["record", "term"]).select(
        "uid", "doc_id", "key", F.when(F.col("remove"), TO_REMOVE).otherwise(TO_GENERALISE).alias("kind_no"), F.when(F.col("remove"), F.lit("remove")).otherwise(F.lit("generalise")).alias("kind"), F.col("term").alias("value"), "start", "end"
    )


def spans(docs: DataFrame, light: DataFrame, text_col: str = "text", each: bool = False) -> DataFrame:
    """All spans of the scanned documents: the entities, and revealing terms that overlap none of them."""
    base = stored(base_spans(light), "base")
    extra = revealing(docs, light, base, text_col, each)
    kept = ["uid", "doc_id", "key", "kind_no", "kind", "value", "start", "end"]
    both = base.select(*kept).union(extra.select(*kept))
    is_base = F.col("kind_no") <= SECRET
    before = Window.partitionBy("uid").orderBy("start", "kind_no").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("uid").orderBy("start", "kind_no").rowsBetween(1, Window.unboundedFollowing)
    last, following = F.max(F.when(is_base, F.col("end"))).over(before), F.min(F.when(is_base, F.col("start"))).over(after)
    return stored(both.withColumns({"last": last, "following": following}).where(is_base | ((F.coalesce("last", F.lit(0)) <= F.col("start")) & (F.coalesce("following", F.col("end")) >= F.col("end")))).select(*kept), "spans")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", each: bool = False) -> DataFrame:
    """One row a document: id, counts by kind, digest of the base spans, the list of all spans, and their number.

    ``each``: terms are held against every entity of their document as well as against its record.

    Null and empty texts have none. Rows of one id are rows of their own; other columns are ignored."""
    light = stored(scan(docs, id_col, text_col), "scan")
    found = spans(docs, light, text_col, each)
    item = F.struct("start", "kind_no", F.concat_ws(":", "kind", "start", "end").alias("s"))
    text = lambda items: F.array_join(F.transform(F.array_sort(items), lambda x: x["s"]), ",")
    by_doc = found.groupBy("uid").agg(
        *[F.sum((F.col("kind_no") == no).cast("long")).alias(f"n_{kind}") for no, kind in enumerate(KINDS)],
        text(F.collect_list(F.when(F.col("kind_no") < SECRET, item))).alias("base"), text(F.collect_list(item)).alias("spans"), F.count(F.lit(1)).alias("n_spans"),
    ).withColumnRenamed("uid", "u")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return light.select("uid", "doc_id").join(by_doc, F.col("uid") == F.col("u"), "left").select(
        F.col("doc_id").alias(id_col), *[zero(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_spans")
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", each: bool = False) -> DataFrame:
    """``docs`` with its texts sanitised: entities become [KIND], terms to generalise [TERM], terms to remove go. Other columns stay.

    ``each``: as in ``find``.

    Null texts stay null. Texts without a match are not moved; only the others are joined with their spans. Rows of one id and one text get the same
    text; rows of one id and different texts each their own."""
    light = stored(scan(docs, id_col, text_col), "scan")
    found = spans(docs, light, text_col, each)
    # one set of spans for each different (id, text); overlapping ones are covered together
    one = found.groupBy("doc_id", "key").agg(F.min("uid").alias("u")).select(F.col("u").alias("uid"))
    rows = found.join(one, "uid")
    order = Window.partitionBy("uid").orderBy("start", F.desc("end"), "kind_no")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.coalesce("reach", F.lit(-1)) > F.col("start"), 0).otherwise(1)).over(order)
    label = F.when(F.col("kind_no") <= SECRET, F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).when(F.col("kind") == "generalise", F.lit("[TERM]")).otherwise(F.lit(""))
    cover = rows.withColumn("reach", reach).withColumn("g", group).groupBy("uid", "doc_id", "key", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(label, F.struct("start", "kind_no")).alias("label"))
    previous = F.coalesce(F.lag("end").over(Window.partitionBy("uid").orderBy("g")), F.lit(0))
    plan = cover.withColumn("from", previous).groupBy("uid", "doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "from", "label"))).alias("_hf_plan")).select(F.col("doc_id").alias("_hf_id"), F.col("key").alias("_hf_key"), "_hf_plan")
    text = F.coalesce(F.col(text_col), F.lit(""))
    may = F.lit(False)
    for kind in PATTERNS:
        may = may | _gate(kind, text)
    part = F.transform("_hf_plan", lambda x: F.concat(F.substring(text, x["from"] + 1, x["start"] - x["from"]), x["label"]))
    end = F.element_at("_hf_plan", -1)["end"]
    clean = F.concat(F.array_join(part, ""), F.substring(text, end + 1, F.length(text)))
    moved = docs.where(may).join(plan, F.col(id_col).eqNullSafe(F.col("_hf_id")) & (F.xxhash64(text) == F.col("_hf_key")), "left").select(*[F.when(F.col("_hf_plan").isNull(), F.col(c)).otherwise(clean).alias(c) if c == text_col else F.col(c) for c in docs.columns])
    return docs.where(~may).union(moved)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), each=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, sanitised; terms are held against its record and each of its entities."""
    return sanitise(docs, each=True)


def _sql() -> str:
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    plain["secret"] = PATTERNS["secret"].replace("++", "+").replace("}+", "}").replace("'", "''")
    found = " UNION ALL ".join(f"SELECT doc_id, {no} AS kind_no, '{kind}' AS kind, regexp_extract_all(t, '{plain[kind]}') AS m, regexp_split_to_array(t, '{plain[kind]}') AS g FROM d" for no, kind in enumerate(PATTERNS))
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    digit = f"CAST(substr(reverse({digits}), i, 1) AS INT)"
    valid = f"""CASE kind WHEN 'email' THEN TRUE WHEN 'secret' THEN TRUE
 WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda q: length(ltrim(q, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(q, '0'), '') AS INT), 0) > 255)) = 0
 WHEN 'card' THEN length({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0
 ELSE length({digits}) BETWEEN 9 AND 15 END"""
    term = r"\p{L}{3,}"
    listed = lambda only: f"coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind_no) FILTER ({only}), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
x AS (SELECT doc_id, kind_no, kind, i, m[i] AS v, g[i] AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
y AS (SELECT *, sum(length(gap) + length(v)) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS e FROM x),
base AS (SELECT *, e - length(v) AS s, kind || ':' || CASE kind WHEN 'email' THEN lower(v) WHEN 'ip' THEN v WHEN 'secret' THEN v ELSE {digits} END AS entity FROM y WHERE {valid}),
rec AS (SELECT doc_id, string_agg(DISTINCT entity, chr(10) ORDER BY entity) AS record FROM base GROUP BY doc_id),
w AS (SELECT doc_id, record, w, g, unnest(range(1, len(w) + 1)) AS k FROM (SELECT doc_id, record, regexp_extract_all(t, '{term}') AS w, regexp_split_to_array(t, '{term}') AS g FROM d JOIN rec USING (doc_id))),
occ AS (SELECT doc_id, record, lower(w[k]) AS term, length(w[k]) AS n, sum(length(g[k]) + length(w[k])) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM w),
co AS (SELECT record, term, count(DISTINCT doc_id) AS co FROM occ GROUP BY 1, 2),
dr AS (SELECT record, count(*) AS df_r FROM rec GROUP BY 1),
dt AS (SELECT term, count(*) AS df_t FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(t, '{term}'), lambda q: lower(q)))) AS term FROM d) GROUP BY 1),
ic AS (SELECT record, log2((SELECT count(*) FROM d)::DOUBLE / df_r) AS ic FROM dr),
told AS (SELECT record, term, least({QUARTER}::DOUBLE * ic, greatest({BIT}::DOUBLE, {TENTH}::DOUBLE * ic)) AS most, log2((df_t + {SMOOTHING}::DOUBLE) / co) AS unknown FROM co JOIN ic USING (record) JOIN dt USING (term) WHERE ic > 0),
hits AS (SELECT doc_id, e - n AS s, e, unknown <= {REMOVE}::DOUBLE * most AS remove FROM occ JOIN told USING (record, term) WHERE unknown <= most),
spans AS (SELECT doc_id, kind_no, kind, s, e FROM base UNION ALL
 SELECT doc_id, CASE WHEN remove THEN {TO_REMOVE} ELSE {TO_GENERALISE} END, CASE WHEN remove THEN 'remove' ELSE 'generalise' END, s, e FROM hits h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.s < h.e AND b.e > h.s)),
r AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind_no = {no}) AS n_{k}" for no, k in enumerate(KINDS))}, {listed(f"kind_no < {SECRET}")} AS b, {listed("TRUE")} AS spans, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN r USING (doc_id)
"""


ORACLE_SQL = _sql()


def _entities_sql() -> str:
    """The whole rule of ``op1_pii``: a document's record and each of its entities are its subjects. ORACLE_SQL knows records only; both say the same of
    tables in which no entity is part of two records."""
    sql = ORACLE_SQL
    for old, new in (
        ("occ AS (SELECT doc_id, record, ", "sub AS (SELECT doc_id, 'all ' || record AS record FROM rec UNION SELECT doc_id, 'one ' || entity FROM base),\nocc AS (SELECT doc_id, sub.record, term, n, e FROM (SELECT doc_id, "),
        (" AS e FROM w),", " AS e FROM w) JOIN sub USING (doc_id)),"),
        ("AS df_r FROM rec GROUP BY 1", "AS df_r FROM sub GROUP BY 1"),
        (f"e - n AS s, e, unknown <= {REMOVE}::DOUBLE * most AS remove", f"e - n AS s, e, bool_or(unknown <= {REMOVE}::DOUBLE * most) AS remove"),
        ("WHERE unknown <= most)", "WHERE unknown <= most GROUP BY doc_id, e - n, e)"),
    ):
        assert sql.count(old) == 1, old
        sql = sql.replace(old, new)
    return sql


ENTITIES_SQL = _entities_sql()
