"""Corpus operators against plain versions on small tables, and their defined results for odd input."""

import collections
import hashlib
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import spark_rows, sql_rows
from hushframe.llm import common, decontam, html, jaccard, licenses, neardup, packing, pii, queries, sharding, tokens, toxicity, warc
from hushframe.llm.common import components, with_rank, without

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"), (7, "Ünï çödé " * 20),
    (8, "x" * 50_000), (9, "word " * 30_000), (None, "one two"), (None, None), (10, "a b c d e f g h i j k l m"), (11, "\x00nul \U0001f600 end"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with extra columns whose names operators use inside."""
    names = ["n", "size", "node", "p", "label", "hub", "start", "end", "key", "word", "plan", "digest"]
    return spark.createDataFrame([(i, t, *range(len(names))) for i, t in ODD], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == sql_rows(queries.oracle_sql()[name], SF)


# what several share


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rank_and_without(spark):
    rows = spark.range(500).withColumn("k", F.when(F.col("id") % 10 < 9, 0).otherwise(1)).repartition(5)
    ranked = with_rank(rows, ["k"], [F.col("id")], F.xxhash64("id"), 7).collect()
    for k, n in ((0, 450), (1, 50)):
        assert sorted(r["rank"] for r in ranked if r["k"] == k) == list(range(n))
    assert without(rows.withColumnRenamed("id", "doc_id"), spark.range(100).withColumnRenamed("id", "x")).count() == 400


def test_tokens():
    draw = random.Random(1)
    texts = ["".join(draw.choice("aZé 9.-\n\x7f☃") for _ in range(draw.randrange(40))) for _ in range(200)] + [None, ""]
    data, at = tokens.buffers(pa.array(texts))
    low = tokens.LOWER[data]
    starts, ends, first = tokens.words(low, at, tokens.ALNUM)
    found = [[bytes(low[s:e]).decode() for s, e in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert found == [decontam._WORD.findall((t or "").translate(LOWER)) for t in texts]
    h = tokens.hashes(low, starts, ends)
    by_word = collections.defaultdict(set)
    for s, e, x in zip(starts, ends, h, strict=True):
        by_word[bytes(low[s:e])].add(int(x))
    assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)


# 1 personal data


def base_spans(x):
    x, out = x or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


HARD = [
    "a@b.c_d@e.f", "x@y", "a@a@a.b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1", "4111 1111-1111 1111", "4111  1111 1111 1111", "+1 (663) 555-6869", "+1-", "++49 30 1234567--",
    "é4111111111111111é x@é.de a@b.de", "a" * 5000 + "@", "1" * 5000, "+" + "1 " * 500, "@@@a.b@c-d.e-f.", ".@a.b", "a@b..c", "0" * 19, "00 0000 000000", "+12.34.5.6.7890", "1.1.1.1@2.2.2", "a.a" * 3000 + "@b" + ".c" * 3000,
]


def test_pii_base(spark, odd):
    rows = [(i, t) for i, t in enumerate(HARD)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in found} == {i: hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest() for i, t in rows}
    assert all([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k) for s in base_spans(HARD[r["doc_id"]])) for k in pii.KINDS] for r in found)
    assert pii.find(odd).count() == len(ODD) and pii.find(odd.limit(0)).count() == 0
    assert [r["text"] for r in pii.sanitise(odd).collect()].count(None) == 2 and pii.sanitise(odd).columns == odd.columns


SECRET = re.compile(r"""(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Aa]pi_?[Kk]ey|API_?KEY|[Aa]ccess_?[Kk]ey|ACCESS_?KEY)["']? ?[=:] ?["']?[A-Za-z0-9_/+.=-]{16,}""")


def sanitisation(rows):
    """All spans of (id, text) rows by plain counting: entities, then terms by what they reveal of their document's record."""
    entities, terms = {}, {}
    for i, t in rows:
        spans = [s.split(":") for s in base_spans(t) if s] + [["secret", m.start(), m.end()] for m in SECRET.finditer(t)]
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        value = lambda k, x: x.lower() if k == "email" else x if k in ("ip", "secret") else re.sub("[^0-9]", "", x)
        entities[i] = (spans, frozenset((k, value(k, t[a:b])) for k, a, b in spans))
        terms[i] = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
    n = len(rows)
    df_t = collections.Counter(w for i in terms for w in {x[0] for x in terms[i]})
    df_r = collections.Counter(r for _, r in entities.values() if r)
    co = collections.Counter((r, w) for i, (_, r) in entities.items() if r for w in {x[0] for x in terms[i]})
    out = {}
    for i, (spans, r) in entities.items():
        found = [(a, ["email", "ip", "card", "phone", "secret"].index(k), f"{k}:{a}:{b}") for k, a, b in spans]
        for w, a, b in terms[i] if r else ():
            ic = math.log2(n / df_r[r])
            unknown, most = math.log2((df_t[w] + 1) / co[r, w]), min(0.25 * ic, max(1, 0.1 * ic))
            if ic > 0 and unknown <= most and not any(x < b and y > a for _, x, y in spans):
                found.append((a, 6, f"remove:{a}:{b}") if unknown <= 0.6 * most else (a, 5, f"generalise:{a}:{b}"))
        out[i] = ",".join(x[2] for x in sorted(found))
    return out


def test_pii_terms(spark):
    draw = random.Random(2)
    word = lambda: "w" + "".join(draw.choice("abcdefgh") for _ in range(3))
    line = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, line(40) + (" . Zorblax lives at a@b.example quietly . " if i < 5 else " . ") + line(40)) for i in range(200)]
    rows += [(300, line(60) + " Only Qwixel here, +1 (663) 555-6869. " + line(9)), (301, f'{line(9)} token = "{"ab12" * 10}" of Mumblo'), (302, "Mumblo " + line(30)), (303, f"Zorblax {line(20)} a@b.example 10.1.2.3")]
    rows += [(1000 + i, "Copied Quux c@d.example") for i in range(20)]
    there = sanitisation(rows)
    found = {r["doc_id"]: (r["spans"], r["n_spans"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {i: (x, len(x.split(",")) if x else 0) for i, x in there.items()}
    for i, name, kind in [*((i, "Zorblax", "generalise|remove") for i in range(5)), (300, "Qwixel", "generalise"), (1000, "Quux", "remove")]:
        at = dict(rows)[i].index(name)
        assert re.search(f"(?:{kind}):{at}:{at + len(name)}(?:,|$)", found[i][0])
    assert all(not found[i][0] for i, t in rows if 5 <= i < 300 or i == 302)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[7] == rows[7][1] and "[SECRET]" in clean[301]
    assert clean[1000] == "  [EMAIL]" and "[TERM]" in clean[300]


def test_pii_adds_spans_to_given_tables(spark):
    found = pii.op1_pii(spark, "/root/testdata/sf0.01")
    assert found.where("spans LIKE '%generalise:%'").count() > 20 and found.where("spans LIKE '%remove:%'").count() > 0
    assert found.where("n_spans > 0 AND n_email + n_ip + n_card + n_phone = 0 AND NOT spans LIKE '%secret:%'").count() == 0


def test_pii_terms_of_entities_in_several_records(spark, tmp_path):
    """Each document has a phone number of its own beside the email that its name goes with, so no two have the same record."""
    draw = random.Random(3)
    line = lambda: " ".join("w" + "".join(draw.choice("abcdefgh") for _ in range(3)) for _ in range(20))
    rows = [(i, f"{line()} Zorblax {line()} a@b.example, f@g.example, +1 (663) 555-{1000 + i}") for i in range(6)] + [(6, f"Mumblo 10.1.2.3 c@d.example Zorblax +1 663 555 {1000 + 4}"), (7, "Mumblo 10.1.2.3"), (8, "c@d.example Quux"), (9, None)]
    rows += [(20 + i, line()) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    found = pii.op1_pii(spark, str(tmp_path))
    assert spark_rows(found) == sql_rows(pii.ENTITIES_SQL, str(tmp_path))
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    for i, name in [*((i, "Zorblax") for i in range(6)), (6, "Mumblo"), (7, "Mumblo")]:
        at = dict(rows)[i].index(name)
        assert re.search(f"(?:generalise|remove):{at}:{at + len(name)}(?:,|$)", spans[i])
    clean = {r["doc_id"]: r["text"] for r in pii.stage(spark, table, SF).collect()}
    assert not any("Zorblax" in clean[i] for i in range(6)) and clean[20] == dict(rows)[20] and clean[9] is None
    by_record = {r["doc_id"]: set(r["spans"].split(",")) for r in pii.find(table).collect()}
    at = lambda x: {s.split(":", 1)[1] for s in x if s}
    assert all(at(by_record[i]) <= at(spans[i].split(",")) for i in by_record)


def test_pii_lists_of_entities_are_not_multiplied_out(spark, tmp_path, monkeypatch):
    """Two lists of names and emails, and a document for each of them: no table has a row for every email and every name of a list."""
    name = lambda i: "n" + "".join("abcdefghij"[int(c)] for c in f"{i:03d}")
    both = ". ".join(f"{name(i)} at m{i}@list.example" for i in range(80))
    rows = [(1, both), (2, f"{both}. Later +1 (663) 555-1000"), *((10 + i, f"{name(i)} has m{i}@list.example or +1 (663) 555-{2000 + i}") for i in range(80)), *((200 + i, f"nothing {name(500 + i)}") for i in range(300))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    made, stored = {}, pii.stored

    def counted(df, name):
        df = stored(df, name)
        made[name] = df.count()
        return df

    monkeypatch.setattr(pii, "stored", counted)
    found = pii.op1_pii(spark, str(tmp_path))
    assert max(made.values()) <= 2 * made["terms"]
    assert spark_rows(found) == sql_rows(pii.ENTITIES_SQL, str(tmp_path))
    text = dict(rows)
    for r in found.where("doc_id BETWEEN 10 AND 89").collect():
        assert re.search(r"(?:generalise|remove):0:4(?:,|$)", r["spans"]), text[r["doc_id"]]


@pytest.mark.parametrize("large", [0, 0.6, 16])
def test_pii_large_records(spark, tmp_path, monkeypatch, large):
    """Whatever records count as large, the spans are those of the whole rule: here all, some and none."""
    monkeypatch.setattr(pii, "LARGE", large)
    draw = random.Random(6)
    word = lambda n: "w" + "".join("abcdefgh"[int(c)] for c in f"{draw.randrange(n):03o}")
    entity = lambda: draw.choice([f"e{draw.randrange(6)}@x.example", f"10.0.0.{draw.randrange(4)}", f"+1 (663) 555-{1000 + draw.randrange(60)}", "1@2.3"])
    rows = [(i, " ".join(draw.choice([entity, lambda: word(60)])() for _ in range(draw.randrange(1, 16)))) for i in range(70)]
    rows += [(100 + i, text) for i, (_, text) in enumerate(rows[:15])] + [(150, "1@2.3"), (151, "1@2.3 +1 (663) 555-9000"), (152, None)]
    rows += [(200 + i, " ".join(word(512) for _ in range(5))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sizes, beside = [], pii.beside
    monkeypatch.setattr(pii, "beside", lambda *x: [sizes.append(t.count()) or t for t in beside(*x)])
    found = spark_rows(pii.op1_pii(spark, str(tmp_path)))
    assert found == sql_rows(pii.ENTITIES_SQL, str(tmp_path)) != sql_rows(pii.ORACLE_SQL, str(tmp_path))
    assert [n > 0 for n in sizes] == [large > 0, large < 16]


# 2 vectors


def test_vectors(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(700, 24))
    x[500:600] = x[3] + 0.08 * draw.normal(size=(100, 24))
    x[600:650] = x[4]
    x[650:] = x[5:55] * 3.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = {r["vec_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = sum(r["n_links"] for r in found.values())
    assert 0.98 * near.sum() <= got <= near.sum()
    label = neardup._join(np.arange(len(x)), *np.nonzero(near))
    assert sum(found[i]["component_id"] == label[i] for i in range(len(x))) >= 0.99 * len(x)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [math.nan, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (8, []), (9, [math.inf, 1.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0])]
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, node long, v long")
    found = sorted(neardup.near_duplicates(table).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"]))
    assert [(r["vec_id"], r["n_links"], r["component_id"]) for r in found] == [(1, 2, 1), (1, 2, 1), (2, 2, 1), *[(i, 0, i) for i in range(3, 10)], (None, 0, None)]
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_oversized_cluster(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CAP", 60)
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(size=(1, 16)) + 0.05 * draw.normal(size=(150, 16)), draw.normal(size=(100, 16))])
    found = neardup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert sum(r["n_links"] for r in found) >= 0.98 * ((u @ u.T >= 0.9).sum() - len(x))


# 3 benchmark


def contaminated(docs, items):
    word = lambda t: decontam._WORD.findall((t or "").translate(LOWER))
    out = []
    for i, t in docs:
        w, hit, names = word(t), set(), set()
        for name, it in items:
            iw = word(it)
            for j in range(max(1, len(iw) - 9) if iw else 0):
                win = iw[j : j + 10]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        names |= {str(name)} if name is not None else set()
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    draw = random.Random(8)
    text = lambda n: " ".join(draw.choice(["the", "of", "a", "Ünit", "x9"]) for _ in range(n))
    items = [(10, text(14)), (9, text(11)), (7, "The of"), (8, None), (6, ""), (5, "never seen words"), (9, text(12)), (4, "the")]
    docs = [(i, text(draw.randrange(40)) + (" " + items[i % 2][1] if i % 3 == 0 else "")) for i in range(30)] + [(99, None), (98, "..."), (3, "the of"), (3, "the of")]
    found = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == contaminated(docs, items)


def test_decontamination_blocks(spark, odd, monkeypatch):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "one two"), (3, "c d e f g h i j k l m")], "item_id long, text string")
    plain = sorted(map(repr, decontam.decontaminate(odd, items).collect()))
    assert sum("contaminated=True" in r for r in plain) == 6
    monkeypatch.setattr(decontam, "blocks", lambda b: ([tuple(r)] for r in b.toLocalIterator()))
    assert sorted(map(repr, decontam.decontaminate(odd, items).collect())) == plain
    assert decontam.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(odd.limit(0), items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red green x x x x blue"), (2, "blue x red x green"), (3, "red"), (4, "green blue")], "doc_id long, text string")
    index = decontam.build(docs)
    hits = lambda **terms: {(r["segment"], r["row"]) for within in [terms.pop("within")] for r in decontam.near(index, terms, within).collect()}
    assert len(hits(a=["red", "GREEN blue"], within=4)) == 1 and len(hits(a=["red green", "blue"], within=6)) == 2
    assert hits(a=["red gone"], within=9) == set() and decontam.near(index, {"a": ["..."]}, 5) is None


def test_proximity_against_brute_force(spark, odd):
    draw = random.Random(12)
    text = lambda n: " ".join(draw.choice(["the", "of", "A", "Ünit", "x9", "rare1", "rare2"]) for _ in range(n))
    items = [(1, "rare1 the rare2"), (2, "of"), (3, None), (4, "gone x9"), (5, "rare2 Ünit a of the"), (5, "rare1"), (None, "the of")]
    docs = [(i, text(draw.randrange(60))) for i in range(60)] + [(99, None), (98, ""), (97, "the of"), (97, "the of")]
    split = lambda t: decontam._WORD.findall((t or "").translate(LOWER))
    total = collections.Counter(w for _, t in docs for w in split(t))
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i].update(split(t))
    rows = []
    for i, t in docs:
        w, names = split(t), []
        for item, words in asked.items():
            chosen = sorted(words, key=lambda x: (total[x], x))[:3]
            places = [[k for k, x in enumerate(w) if x == c] for c in chosen]
            if chosen and any(all(any(abs(p - q) <= 10 for q in other) for other in places[1:]) for p in places[0]):
                names.append(str(item))
        rows.append((i, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    found = decontam.proximity(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted(rows) and any(r[1] for r in rows)
    assert decontam.proximity(odd, spark.createDataFrame([], "item_id long, text string")).where("n_near = 0").count() == len(ODD)


def test_lists(spark):
    draw = random.Random(2)
    words = sorted(draw.sample(range(-1000, 1000), 40))
    places = {w: sorted(draw.sample(range(500), draw.randrange(1, 60))) for w in words}
    packed = []
    for w in words:
        data, at = decontam.pack_gaps(np.array([0]), np.array(places[w]))
        packed.append(data.tobytes())
    lists = decontam.Lists(pa.table({"word": pa.array(words), "n": [len(places[w]) for w in words], "postings": pa.array(packed, pa.binary())}))
    asked = np.array([draw.randrange(-1001, 1001) for _ in range(500)] + words)
    where = np.array([draw.randrange(-2, 502) for _ in asked])
    rank = lists.rank(asked)
    assert lists.has(rank, where).tolist() == [p in places.get(w, ()) for w, p in zip(asked.tolist(), where.tolist(), strict=True)]
    lo, hi = np.maximum(where - 7, 3), np.minimum(where + 5, 400)
    assert lists.near(rank, where, 6, lo, hi).tolist() == [any(abs(q - p) <= 6 and a <= q < b for q in places.get(w, ())) for w, p, a, b in zip(asked.tolist(), where.tolist(), lo.tolist(), hi.tolist(), strict=True)]
    assert sorted((i, p) for which, ps in lists.starts(asked) for i, p in zip(which.tolist(), ps.tolist(), strict=True)) == sorted((i, p) for i, w in enumerate(asked.tolist()) for p in places.get(w, ()))


def test_gaps():
    lists = [np.array([0]), np.array([5, 6, 300, 70_000, 2**31]), np.array([127, 128])]
    starts = np.cumsum([0, 1, 5])
    data, at = decontam.pack_gaps(starts, np.concatenate(lists))
    for i, x in enumerate(lists):
        assert decontam.unpack_gaps(data[at[i] : at[i + 1]].tobytes()).tolist() == x.tolist()


# 4 shards


def draw_order(rows):
    return random.Random(3).sample(rows, len(rows))


def test_cut(spark):
    """Propagation keeps most of the links, and cuts far fewer than dealing rows out does."""
    draw = random.Random(11)
    rows, n = [], 0
    for g in range(300):
        for _ in range(draw.choice([1, 1, 2, 3, 5, 12, 40])):
            rows.append((n, f"group {g}"))
            n += 1
    found = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    kept = lambda of: sum(c * (c - 1) // 2 for ids in groups.values() for c in collections.Counter(of[i] for i in ids).values())
    every = sum(len(x) * (len(x) - 1) // 2 for x in groups.values())
    # all rows but the single ones are linked, so shards have hardly any room to begin with
    assert every - kept({i: i % 8 for i, _ in rows}) > 4 * (every - kept(found)) and kept(found) >= 0.75 * every


def test_shards(spark, odd):
    rows = [(i, f"text {i}") for i in range(300)] + [(1000 + i, f"pair {i // 2}") for i in range(200)] + [(5000 + i, "hot") for i in range(250)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).toPandas()
    sizes = found.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in found.groupby("shard"))
    text = dict(rows)
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in found.itertuples())
    group = found.assign(t=found["doc_id"].map(text)).groupby("t")["shard"].nunique()
    assert group.drop("hot").max() == 1 and group["hot"] <= 4  # 250 rows need three shards of 94
    again = sharding.shard(spark.createDataFrame(draw_order(rows), "doc_id long, text string").repartition(7)).toPandas()
    assert found.sort_values("doc_id")[["shard", "slot"]].to_numpy().tolist() == again.sort_values("doc_id")[["shard", "slot"]].to_numpy().tolist()
    one = {r["doc_id"]: r for r in sharding.shard(odd).collect()}
    assert one[1]["size"] == 1 and one[1]["text_crc32"] == 0 and one[7]["size"] == len(ODD[7][1].encode()) + 1 and one[7]["text_crc32"] == zlib.crc32(ODD[7][1].encode())
    assert sharding.shard(odd).count() == len(ODD) and sharding.shard(odd.limit(0)).count() == 0


# 5 toxicity


def test_toxicity_learns(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = toxicity.op5_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    hit = scored[scored["predicted"] == 1]
    assert (hit["toxic"] == 1).mean() > 0.8 and (scored[scored["toxic"] == 1]["predicted"]).mean() > 0.7
    assert docs.count() == 1000 and scored["score"].between(0, 1).all()


@pytest.mark.parametrize("shift", [0.0, 4.0, -9.0])
def test_risk_gradient(shift):
    """By finite differences, with the bracket above and below zero; without labels among the unlabelled it is the textbook estimator."""
    draw = np.random.default_rng(3)
    toxic = draw.random(60) < 0.3
    z = draw.normal(size=60) + np.where(toxic, shift, -shift)
    value, g = toxicity.risk(z, toxic, 0.4)
    for i in range(0, 60, 7):
        up, down = z.copy(), z.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((toxicity.risk(up, toxic, 0.4)[0] - toxicity.risk(down, toxic, 0.4)[0]) / 2e-5 - g[i]) < 1e-6
    loss = lambda x, y: np.mean([math.log1p(math.exp(-y * v)) for v in x])
    bracket = loss(z[~toxic], -1) - 0.4 * loss(z[toxic], -1)
    assert abs(value - (0.4 * loss(z[toxic], 1) + bracket if bracket >= 0 else -bracket)) < 1e-9
    assert (bracket < 0) == (shift == 4.0)


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(6, 1), (6, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.fit(odd, known)
        found = toxicity.score(odd, model).collect()
        assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_learns_without_files(spark):
    """Tables of the sample's entries are not written, and the model is that of a plain count over the sample."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").select("doc_id", c) for t, c in (("documents", "text"), ("labels", "toxic")))
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(shared.rglob("*"))
    model = toxicity.fit(docs, labels, n_features=50)
    assert set(shared.rglob("*")) <= before
    known = dict(map(tuple, labels.collect()))
    texts = {i: t for i, t in docs.where(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").collect()}
    some = None if any(known.get(i) is None for i in texts) else 0
    ids = [i for i in texts if known.get(i) == 1] + [i for i in texts if known.get(i) == some]
    toxic = np.array([known.get(i) == 1 for i in ids])
    found = [toxicity.features(pa.array([texts[i]])) for i in ids]
    n, seen = (toxic.sum(), (~toxic).sum()), {}
    for is_toxic, (_, feature, _, _) in zip(toxic, found, strict=True):
        for f in feature.tolist():
            seen.setdefault(f, [0, 0])[0 if is_toxic else 1] += 1
    part = lambda x, total, rate: x * math.log(x / total / rate) if x else 0.0
    gain = {f: sum(part(x, m, r) + part(m - x, m, 1 - r) for x, m in zip(c, n, strict=True)) for f, c in seen.items() if c[0] >= 3 and c[0] / n[0] > c[1] / n[1] for r in [sum(c) / sum(n)]}
    keys = np.array(sorted(sorted(f for f in gain if gain[f] > 3), key=lambda f: -round(gain[f], 9))[:50])
    keys.sort()
    assert model.keys.tolist() == keys.tolist() and len(keys)
    entries = [(row, np.searchsorted(keys, f), toxicity.weight(c, w[0])) for row, (_, feature, count, w) in enumerate(found) for f, c in zip(feature, count, strict=True) if f in keys]
    row, col, value = (np.array(x) for x in zip(*entries, strict=True))
    labelled = [known[i] for i in texts if known.get(i) is not None]
    plain = toxicity.train(keys, row, col, value.astype(np.float32), toxic, sum(labelled) / len(labelled))
    assert np.allclose(model.weights, plain.weights) and abs(model.bias - plain.bias) < 1e-6


# 6 n-grams


def jaccard_components(docs, size=4, percent=85):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(docs)):
        if docs[i][0] is not None:
            least[find(i)] = min(least.get(find(i), docs[i][0]), docs[i][0])
    return sorted(((docs[i][0], len(sets[i]), least.get(find(i))) for i in range(len(docs))), key=repr)


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 4, 85), (3, 5, 80), (4, 5, 80)])
def test_jaccard(spark, seed, size, percent):
    draw = random.Random(seed)
    docs = []
    for base in range(14):
        words = [f"w{draw.randrange(300)}" for _ in range(draw.choice([3, 5, 8, 20, 60, 150]))]
        for _ in range(draw.randrange(1, 7)):
            copy = list(words)
            for _ in range(draw.randrange(0, 1 + len(words) // 25 + 1)):
                copy[draw.randrange(len(copy))] = f"z{draw.randrange(1000)}"
            docs.append((len(docs) * 7 % 101 + base, " ".join(copy)))
    docs += [(i, t) for i, t in ODD if t is None or len(t) < 1000]
    found = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), size, percent)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == jaccard_components(docs, size, percent)


def test_jaccard_odd(spark, odd):
    assert jaccard.join(odd).count() == len(ODD) and jaccard.join(odd.limit(0)).count() == 0


def test_members_compared_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 3)
    draw = np.random.default_rng(3)
    about, who = [], []
    for sig in range(6):
        common = draw.integers(0, 4, jaccard.SKETCH).astype(np.uint8)
        for k in range(int(draw.integers(1, 12))):
            own = common.copy()
            own[draw.integers(0, jaccard.SKETCH, 30 * (k % 3))] += 1
            part = int(draw.integers(0, 4))
            about.append((sig * 100 + k, int(own.sum()), bytes(own)))
            # some share many signatures, and some more than a member carries along
            who += [(1000 * sig + 7 * t, sig * 100 + k, part) for t in range(1 if k % 2 else 40) if t == 0 or draw.random() < 0.8]
    n, sketch, of = {a[0]: a[1] for a in about}, {a[0]: np.frombuffer(a[2], np.uint8) for a in about}, {w[1]: w[2] for w in who}
    want = set()
    for s, a, _ in who:
        for t, b, _ in who:
            if s == t and a < b and of[a] != of[b]:
                least = np.minimum(sketch[a], sketch[b]).sum(dtype=int)
                if 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b]) and 100 * least >= 85 * (n[a] + n[b] - least):
                    want.add((a, b))
    given = spark.createDataFrame(who, "sig long, node long, part long").repartition(3)
    sized = spark.createDataFrame(about, "node long, n long, sketch binary").repartition(2)
    assert {tuple(r) for r in jaccard._cross(given, sized, 85).collect()} == want and want


@pytest.mark.parametrize("percent", [85, 80])
def test_signatures_meet(percent):
    draw = np.random.default_rng(0)
    for n in (7, 12, 30, 100, 700, 4000):
        for _ in range(12):
            common = draw.integers(0, 2**63, n).astype(np.uint64)
            extra = int(n * (100 - percent) / percent)
            cut = draw.integers(0, extra + 1)
            x = np.sort(np.concatenate([common, draw.integers(0, 2**63, cut).astype(np.uint64)]))
            y = np.sort(np.concatenate([common, draw.integers(0, 2**63, extra - cut).astype(np.uint64)]))
            text = np.repeat([0, 1], [len(x), len(y)])
            sig, node = jaccard.signatures(text, np.concatenate([x, y]), np.array([1, 2]), np.array([len(x), len(y)]), percent)
            if len(x) != n or len(y) != n:
                assert set(sig[node == 1].tolist()) & set(sig[node == 2].tolist()), (n, extra, cut)


# 7 pages


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p>x", "x"), ("plain", "plain"), ("<script>var a='<p>no</p>'", ""), ("a&amp;b &lt;p&gt;", "a&b <p>"),
    ("<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>One, two,<br>three <b>bo</b>ld.</p><div class='ad'>Buy</div><section id='comments'><p>Nice, one, really, good</p></section></article><footer>f</footer></body>", "T One, two, three bold."),
    ("<div id='sidebar'><p>Links, more, links, here, and, there</p></div><div><p>The main text, of some length, goes here.</p><p>Short.</p></div>", "The main text, of some length, goes here. Short."),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<form><p>Your name, please, here</p></form><p>Body, text</p>", "Body, text"),
])
def test_html(page, text):
    assert html.main_text(page) == text


ARTICLE = "<p>The first paragraph, of some length, says what happened, and where.</p><p>The second one, which is longer, says when and why it did, in some detail.</p>"
BODY = "The first paragraph, of some length, says what happened, and where. The second one, which is longer, says when and why it did, in some detail."
MENU = "<div class='menu'><a href=/>Home</a> <a href=/b>Things to buy</a></div>"


@pytest.mark.parametrize(("page", "text"), [
    *[(f"<body>{MENU}<div class='{c}'>{ARTICLE}</div></body>", BODY) for c in ("elementor-widget", "post no-sidebar", "content-with-sidebar", "has-sidebar", "entry form-post", "widget")],
    # every paragraph in a part of its own
    ("<body>" + MENU + "".join(f"<div class='elementor-element elementor-widget'>{p}</p></div>" for p in ARTICLE.split("</p>")[:-1]) + "</body>", BODY),
    (f"<body class='has-sidebar'><div id='sidebar'>{MENU}<p>Other news, of today.</p></div><div class='content-with-sidebar'>{ARTICLE}</div><div class='site-footer'>All rights, of course, reserved here.</div></body>", BODY),
    (f"<div class='content-with-sidebar'>{ARTICLE}<ol class='comments-area'>" + "".join(f"<li class='comment'>Comment {i}, which is, as ever, long, but no part of it.</li>" for i in range(3)) + "</ol></div>", BODY),
    # short text beside the container
    (f"<body>A line before.<div>{ARTICLE}</div><p>Short.</p><div><p>The end, then.</p></div></body>", f"A line before. {BODY} Short. The end, then."),
])
def test_html_names(page, text):
    assert html.main_text(page) == text


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1), (None, None, None, 2)], "page_id long, url string, html string, n_chars int")
    assert sorted(r["n_chars"] for r in html.extract(rows).collect()) == [0, 1, 1] and html.extract(rows.limit(0)).count() == 0


# 8 archives


def test_warc(spark, tmp_path):
    big = "WARC/1.0\r\n\r\n" * 20
    rows = [(1, "http://a.b/x?q", "x" * 200), (2, "http://a.b/x?q", "x" * 200), (3, "http://A.b:8080/y", "y" * 20), (4, "http://a.b/y", "y" * 20), (5, None, None), (6, "http://c/", big), (0, "http://q", "x" * 200), (7, "u\r\nv", "é" * 60), (7, "u\r\nv", "é" * 60)]
    spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted((tuple(r) for r in warc.op8_warc(spark, str(tmp_path)).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert found == sorted(((i, len((t or "").encode()), sha(t), "revisit" if i in (1, 2) else "response", 0 if i in (1, 2) else None) for i, _, t in rows), key=repr)
    warc.write(spark.read.parquet(f"{tmp_path}/pages.parquet"), f"{tmp_path}/archive")
    warc.write_index(warc.captures(spark, f"{tmp_path}/archive"), f"{tmp_path}/index", per_block=2)
    index = warc.Index(spark, f"{tmp_path}/index")
    assert {c["page_id"]: p.decode() for c, p in index.lookup("http://c/")} == {6: big}
    assert {(c["page_id"], c["record_type"]) for c, _ in index.lookup("http://a.b/x?q")} == {(1, "revisit"), (2, "revisit")}
    assert len(index.lookup("uv")) == 2 and index.lookup("http://none/") == []
    keys = spark.createDataFrame([("c)/", 6), ("c)/", 7), (")uv", 7), ("zz", None), ("", 1)], "surt string, page_id long")
    assert sorted((r["surt"], r["page_id"]) for r in warc.lookup(keys, f"{tmp_path}/index").collect()) == [(")uv", 7), (")uv", 7), ("c)/", 6)]
    empty = spark.read.parquet(f"{tmp_path}/pages.parquet").limit(0)
    warc.write(empty, f"{tmp_path}/none")
    assert warc.captures(spark, f"{tmp_path}/none").count() == 0
    empty.write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert warc.op8_warc(spark, f"{tmp_path}/empty").count() == 0


def test_warc_files_are_bounded(spark, tmp_path):
    """One partition of small pages and then large ones; single ones beyond the bound; a large group of copies."""
    draw = random.Random(4)
    rows = [(i, f"http://h{i % 7}/{i}", "s" * draw.randrange(200)) for i in range(400)] + [(1000 + i, "http://big/", "".join(draw.choice("abc") for _ in range(9_000)) * 3) for i in range(120)] + [(2000, "http://one/", "x" * 500_000)]
    rows += [(3000 + i, f"http://copy/{i % 3}", "copy " * 60) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"{tmp_path}/archive", file_bytes=100_000)
    sizes = [p.stat().st_size for p in (tmp_path / "archive").rglob("part-*")]
    assert max(sizes) > 500_000 and sorted(sizes)[-2] <= 100_000 and len(sizes) < 80
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    found = warc.op8_warc(spark, str(tmp_path))
    assert found.count() == len(rows) and found.where("record_type = 'revisit' AND refers_to = 3000").count() == 199


def test_warc_makes_no_other_files(spark, tmp_path):
    """Tasks make files of the archive, the blocks and one directory only, as each file costs an executor a process; nothing stays cached."""
    rows = [(i, f"http://h{i % 7}/{i}", f"page {i % 300} " * 30) for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6).write.parquet(f"{tmp_path}/pages.parquet")
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    files = lambda: {p.relative_to(shared) for p in shared.rglob("part-*")}
    cached = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    had, held = files(), cached()
    found = warc.op8_warc(spark, str(tmp_path))
    new = files() - had
    made = collections.Counter(p.parts[1:3] if p.parts[1:2] == ("index",) else p.parts[1:2] for p in new)
    assert set(made) == {("archive",), ("index", "blocks"), ("index", "directory")} and made["index", "directory"] == 1 and cached() <= held
    # Spark's sinks leave a file of checksums beside each file of a local disk
    own = shared / next(iter(new)).parts[0]
    assert not [p for at in ("archive", "index/blocks") for p in (own / at).rglob("*") if p.name.startswith((".", "_"))]
    assert found.where("record_type = 'revisit' AND refers_to = page_id - 300").count() == 100 and found.count() == 400


def test_warc_sinks_agree(spark, tmp_path, monkeypatch):
    """Archives that tasks write on a local disk hold what Spark's text sink writes elsewhere; a second archive goes beside the first; of a task that runs twice one try counts."""
    rows = [(i, f"http://h{i % 7}/{i}", f"é page {i % 300} " * (i % 90)) for i in range(400)] + [(None, None, None), (9000, "http://big/", "x" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    read = lambda at: collections.Counter(bytes(p) for f in (tmp_path / at).rglob("part-*") for *_, p in [(0, f.read_bytes()[o : o + n]) for o, n, _, _ in warc.records(f.read_bytes())])
    warc.write(pages, f"{tmp_path}/local", file_bytes=20_000)
    assert sorted(f.stat().st_size for f in (tmp_path / "local").rglob("part-*"))[-2] <= 20_000
    once = read("local")
    warc.write(pages, f"{tmp_path}/local")
    assert read("local") == once + once and once.total() == len(rows)
    found = spark.createDataFrame([(f"WARC/1.0\r\nContent-Length: 1\r\n\r\n{i}",) for i in range(8)], "value string").coalesce(1)
    monkeypatch.setattr(warc.uuid, "uuid4", lambda: type("U", (), {"hex": "same"}))
    for _ in range(2):
        warc._sink(found, f"{tmp_path}/twice", 100)
    assert read("twice").total() == 8 and not list((tmp_path / "twice").glob("_*"))
    monkeypatch.undo()
    monkeypatch.setattr(warc, "_local", lambda *_: None)
    warc.write(pages, f"{tmp_path}/sink", file_bytes=20_000)
    assert read("sink") == once and list((tmp_path / "sink").glob("roll=*"))
    warc.write_index(warc.captures(spark, f"{tmp_path}/sink"), f"{tmp_path}/index", per_block=20)
    assert warc.lookup(warc.keys_of(pages), f"{tmp_path}/index").count() == len(rows)
    names = ["page_id", "offset", "length", "payload_digest"]
    remote = sorted(warc.captures(spark, f"{tmp_path}/sink").select(names).collect(), key=repr)
    monkeypatch.undo()
    assert remote == sorted(warc.captures(spark, f"{tmp_path}/sink").select(names).collect(), key=repr)


def test_warc_bytes_that_are_no_utf8(spark, tmp_path):
    """A payload's digest is that of the bytes written."""
    rows = spark.createDataFrame([(i, "http://a/", b"\xff\xfe" + b"x" * 200) for i in (1, 2)], "page_id long, url string, html binary").select("page_id", "url", F.expr("cast(html AS string)").alias("html"))
    warc.write(rows, f"{tmp_path}/archive")
    found = sorted((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in warc.captures(spark, f"{tmp_path}/archive").collect())
    sha = hashlib.sha256(b"\xff\xfe" + b"x" * 200).hexdigest()
    assert found == [(1, "response", 202, sha), (2, "revisit", 202, sha)]


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a " * 300_000 + ">", "<b>" * 20_000 + "</zz>" * 20_000, "<b>" * 20_000 + "<p></p>" * 20_000, "<ul><li><ul>" + "<b>" * 20_000 + "<li></li>" * 20_000, "<a x='\">" * 100_000, "<div class=ad>" * 20_000 + "<h1>x</h1>", "<!--" * 200_000, "<" * 1_000_000])
def test_html_time(page):
    """About a megabyte of what makes careless parsers slow."""
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 1


def test_surt():
    assert warc.surt("http://www.A.org:8080/p?q#f") == "org,a,www:8080)/p?q"


# 9 packing


def test_encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "  a  b   c \n\n d", "a \n b", "a<|endoftext|>b", "é　 ü x", "don't 's  I'll", "x  ", "\n x", "😀 ok", "word " * 50, "1234 5678", "a" * 500]
    draw = random.Random(6)
    texts += ["".join(draw.choice("ab ' \n\té1.") for _ in range(30)) for _ in range(200)]
    encode = packing.encoder("byte_bpe_50k")
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_packing(spark, odd):
    found = packing.pack(packing.pieces(odd)).toPandas()
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 2048
    long = found[found["doc_id"] == 9].sort_values("piece")
    assert long["start"].tolist() == (long["length"].cumsum() - long["length"]).tolist() and set(long["length"][1:]) == {2048}
    assert (found[found["doc_id"].isin([1, 2])]["length"] == 1).all() and len(found[found["doc_id"] == 6]) == 2
    assert packing.pack(packing.pieces(odd.limit(0))).count() == 0


def test_packing_ids(spark):
    """Every piece's ids, by the tokenizers file alone, on a given table; sequences near the least number there can be."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.op9_packing(spark, SF).toPandas()
    tokens = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        tokens += len(ids)
        own = found[found["doc_id"] == r["doc_id"]].sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["length"].sum() == len(ids) and len(own) == max(1, -(-len(ids) // 2048))
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own["start"], own["length"], strict=True)]
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 2048
    assert found["sequence_id"].nunique() <= 1.02 * tokens / 2048 + 1


def test_plan_is_tight():
    draw = random.Random(9)
    for spread in (2048, 700, 60):
        counts = collections.Counter(min(2048, 1 + int(draw.expovariate(1 / spread))) for _ in range(5000))
        rows, n = packing.plan(counts)
        assert n <= 1.03 * sum(k * c for k, c in counts.items()) / 2048 + 2
        ranks = collections.defaultdict(list)
        for length, lo, hi, _, _ in rows:
            ranks[length].append((lo, hi))
        assert all([a for a, _ in sorted(r)] == [0, *[b for _, b in sorted(r)][:-1]] and max(b for _, b in r) == counts[k] for k, r in ranks.items())


# 10 licences


def test_licenses(spark, odd):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "license"), (3, "Licensed under CC BY-NC 4.0.\n\n" + licenses.TEMPLATES["isc"][0].replace(" ", "\n", 9)), (4, licenses.TEMPLATES["unlicense"][0].upper())]
    found = {r["doc_id"]: (r["n_units"], r["licenses"], r["best_license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (3, "mit", "mit"), 2: (0, "", ""), 3: (4, "cc-by-nc-4.0,isc", "cc-by-nc-4.0"), 4: (1, "unlicense", "unlicense")}
    # within a longer paragraph, wrapped over lines, and a whole licence text's paragraphs
    wrapped = "Some words come first, and then more of them. Redistributions of source code must retain the above\n copyright notice, this list of conditions\nand the following disclaimer. And so on, for a while."
    rows = [(1, wrapped), (2, "\n\n".join(licenses.TEMPLATES["mit"][3:])), (3, "It is free. This work is licensed under the GNU General Public License, version 3. Enjoy it, whoever you are, wherever.")]
    found = {r["doc_id"]: (r["licenses"], r["n_units"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == ("bsd", 1) and found[2][0] == "mit" and found[2][1] >= 4 and found[3] == ("gpl-3.0", 1)
    assert licenses.scan(odd).where("n_units > 0").count() == 0 and licenses.scan(odd.limit(0)).count() == 0


def test_gate_covers():
    words = set(licenses.gate_words([licenses.bigrams(t) for x in licenses.TEMPLATES.values() for t in x]))
    draw = random.Random(0)
    for x in licenses.TEMPLATES.values():
        for t in x:
            grams = licenses.bigrams(t)
            for _ in range(50):
                some = draw.sample(grams, math.ceil(2 / 3 * len(grams)))
                assert any(set(g.split()) & words for g in some)


# the pipeline


def test_pipeline(spark, tmp_path):
    import shutil

    import corpus_pipeline

    shutil.copytree(SF, tmp_path / "sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        before = corpus_pipeline.stored(after, name)
    left = {r["doc_id"]: r["text"] for r in before.collect()}
    assert not any(item in t for t in left.values()) and 100 < len(left) < 200
    assert not any(base_spans(t) for t in left.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(left)
    there = set(common.made())
    whole = corpus_pipeline.run(spark, SF)
    assert len(set(common.made()) - there) == 1 and there <= set(common.made())
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, packed.select(*key).collect()))


def test_stages_on_odd_tables(spark, odd):
    """Nulls, empty and very long texts, repeated rows, ties and clashing columns; then no rows at all."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, SF)
        rows = found.collect()
        if name != "packing":
            assert found.columns == odd.columns
        if name in ("toxicity", "decontamination", "pii"):
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in ODD)
        if name == "jaccard":  # one of "One two" and its copies, one of the two equal rows and 10, which has eight of nine shingles in common with them
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, i) for i in (1, 2, 3, 4, 6, 7, 8, 9, 11)] + [(True, 0)]
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_neardup_finds_pairs_that_no_cluster_holds(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PER_SHARD", 30)
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(600, 64)))
    away = rng.normal(size=x.shape)
    away = unit(away - (away * x).sum(1, keepdims=True) * x)
    x = np.concatenate([x, 0.902 * x + np.sqrt(1 - 0.902**2) * away])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r for r in neardup.near_duplicates(table).collect()}
    graph = [r["n_links"] for r in rows.values()]
    assert sum(graph) >= 0.95 * 1200 and max(graph) == 1 and all(r["component_id"] in (i, i % 600) for i, r in rows.items())
    # without a graph that could reach it, all are compared with all, in blocks
    monkeypatch.setattr(neardup, "BLOCK", 64 * 200)
    rows = {r["vec_id"]: r for r in neardup.near_duplicates(table, least_recall=1.1).collect()}
    assert all(rows[i]["n_links"] == 1 and rows[i]["component_id"] == i % 600 for i in range(1200))


def test_neardup_walks_over_shards(spark, monkeypatch):
    """With one cluster a vector, links whose ends are in different clusters are found through neighbours in both."""
    monkeypatch.setattr(neardup, "PER_SHARD", 40)
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    seeds = unit(rng.normal(size=(40, 24)))
    x = unit(np.repeat(seeds, 25, axis=0) + 0.055 * rng.normal(size=(1000, 24)))
    classes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "node long, v array<double>, n long")
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found, expected = neardup._links(classes, 24, 1000, 2, 0.9)
    links = {r["a"]: r["links"] for r in found.groupBy("a").agg(F.sum("links").alias("links")).collect()}
    assert all(links.get(i, 0) <= near[i].sum() for i in range(1000))
    assert sum(links.values()) >= 0.97 * near.sum() and 0 < expected <= 1
    assert neardup.audit(classes, found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")))[0] >= 0.95


def test_stages_remove_rows_not_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    text = " ".join(f"word{i}" for i in range(40))
    clean = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    schema = "doc_id long, text string"
    rows = [(None, text), (None, clean[0]), (7, text), (7, clean[1]), (9, clean[2]), (9, clean[2]), (None, None)]
    left = jaccard.stage(spark, spark.createDataFrame(rows, schema).repartition(3), SF).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([(7, text), (None, clean[0]), (7, clean[1]), (9, clean[2]), (None, None)], key=repr)
    rows = [(None, item), (None, clean[0]), (7, f"{clean[2]} {item}"), (7, clean[1]), (None, None)]
    left = decontam.stage(spark, spark.createDataFrame(rows, schema).repartition(3), SF).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([(None, clean[0]), (7, clean[1]), (None, None)], key=repr)
