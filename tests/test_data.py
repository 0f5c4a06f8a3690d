"""Nested records, rejects, orphans and heavy keys: edge cases against plain Python."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from litweave.operators import heavykeys, nested, orphans, rejects

# nested


def walk(record_id, payload):
    """The rows of one payload, read the plain way."""
    try:
        d = json.loads(payload)
    except (TypeError, ValueError):
        return
    at = lambda x, *path: at(x.get(path[0]), *path[1:]) if path and isinstance(x, dict) else x if not path else None
    many = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    text = lambda x: None if x is None or isinstance(x, (dict, list)) else x if isinstance(x, str) else json.dumps(x)
    out = [("date", 0, 1, at(d, "static_data", "summary", "pub_info", "sortdate"))]
    out += [("title", 0, i, at(t, "content")) for i, t in enumerate(many(at(d, "static_data", "summary", "titles", "title")), 1)]
    out += [("identifier", 0, i, at(t, "value")) for i, t in enumerate(many(at(d, "dynamic_data", "identifiers", "identifier")), 1)]
    for n, a in enumerate(many(at(d, "static_data", "abstracts", "abstract")), 1):
        out += [("paragraph", n, i, at(p, "content") if isinstance(p, dict) else p) for i, p in enumerate(many(at(a, "paragraphs", "p")), 1)]
    for n, a in enumerate(many(at(d, "static_data", "contributors", "author")), 1):
        out.append(("author", 0, n, at(a, "auid")))
        out += [("affiliation", n, i, at(f, "afid")) for i, f in enumerate(many(at(a, "affiliations", "affiliation")), 1)]
    for kind, p, n, v in out:
        if text(v) is not None:
            yield record_id, kind, p, n, text(v)


AUTHOR = {"auid": 7, "given": "Ü", "affiliations": {"affiliation": [{"afid": "1"}, None, {"name": "x"}, {"afid": 60000977}]}}
PAYLOADS = [
    None, "", "no json", "null", "[]", "{}", '"text"', '{"static_data": null}', '{"static_data": {"summary": []}}',
    json.dumps({"static_data": {"summary": {"pub_info": {"sortdate": "2001-02-03"}, "titles": {"title": {"type": "item", "content": "bare"}}}}}),
    json.dumps({"static_data": {"abstracts": {"abstract": [{}, {"paragraphs": {"p": ["a", {"content": None}, None, {"content": "b\n\"c\""}, {}, ["x"]]}}, {"paragraphs": {"p": "bare"}}]}}}),
    json.dumps({"static_data": {"contributors": {"author": [AUTHOR, None, {}, AUTHOR, {"auid": ""}]}}, "dynamic_data": {"identifiers": {"identifier": {"type": "doi", "value": "10.1/x"}}}}),
    json.dumps({"static_data": {"contributors": {"author": AUTHOR}}, "dynamic_data": {"identifiers": {"identifier": []}}}),
    json.dumps({"static_data": {"summary": {"titles": {"title": [{"content": "long " * 50000}]}}}}),
]


def test_nested(spark):
    rows = [(i, p, "clash") for i, p in enumerate(PAYLOADS)] + [(11, PAYLOADS[11], "again")]
    df = spark.createDataFrame(rows, "record_id long, payload string, node_kind string")
    got = sorted(map(tuple, nested.flatten_values(df).collect()))
    assert got == sorted(x for i, p in enumerate(PAYLOADS) for x in walk(i, p))
    assert nested.flatten_values(df.limit(0)).count() == 0


def test_nested_objects_once(spark):
    df = spark.createDataFrame([(i, PAYLOADS[11]) for i in range(50)], "record_id long, payload string")
    store = nested.store_nested(df, "record_id", "payload")
    assert store.table("author").count() == 3  # the author, the empty ones, the one with an empty id
    assert store.roots.select("root").distinct().count() == 1
    assert store.bridge().where("kind = 'affiliation'").count() == 4
    # members in another order are the same object
    swapped = json.dumps(dict(reversed(json.loads(PAYLOADS[11]).items())))
    both = nested.store_nested(spark.createDataFrame([(1, PAYLOADS[11]), (2, swapped)], "record_id long, payload string"), "record_id", "payload")
    assert both.roots.select("root").distinct().count() == 1


# rejects


def parse(line):
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j, value = i + 1, []
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                value.append(line[j:k])
                if line[k + 1 : k + 2] != '"':
                    break
                value.append('"')
                j = k + 2
            out.append("".join(value))
            i = k + 1
            if i < n and line[i] != ",":
                return None
        else:
            k = line.find(",", i)
            k = n if k < 0 else k
            if '"' in line[i:k]:
                return None
            out.append(line[i:k])
            i = k
        if i >= n:
            return out
        i += 1


def reason(line):
    if line is None:
        return "column_count"
    cells = parse(line)
    if cells is None:
        return "quoting"
    if len(cells) != 6:
        return "column_count"
    number, kind, date, title, abstract, doi = cells
    bad = not (number.isascii() and number.isdigit() and len(number) < 10) or not kind.strip() or not title.strip()
    if date:
        try:
            bad |= datetime.strptime(date, "%Y-%m-%d").strftime("%Y-%m-%d") != date
        except ValueError:
            bad = True
    bad |= any(c == "�" or c == "\x7f" or (c < " " and c not in "\t\n\r") for c in title + abstract)
    return "bad_value" if bad or not (doi in ("", "NA") or doi.startswith("10.")) else None


LINES = [
    None, "", ",,,,,", "1,A,2001-02-03,T,B,10.1/x", '1,"A",,"T, ""q""\nx","",', "1,A,2001-02-30,T,B,NA", "1,A,2000-02-29,T,B,", "1,A,1900-02-29,T,B,",
    "1,A,0000-01-01,T,B,", "12345678901,A,,T,B,", "1234567890,A,,T,B,", "１,A,,T,B,", "1, ,,T,B,", "1,A,, ,B,", "1,A,,T,B\x00,", "1,A,,T�,B,", "1,A,,T\x7f,B,",
    "1,A,,T,B\t\r\n,", '1,A,,T,B" ,', '1,A,,"T"x,B,', '1,A,,"T,B,', '"1,A,,T,B,', '1,A,,T,B,"10.1"', '1,A,,T,B, "10.1"', "1,A,,T,B", "1,A,,T,B,,", "1,A,,T,B,doi", '1,A,,T,\\"B,',
    '1,A,,"' + 'x""' * 60000 + '",B,', "1,A,,T," + "y" * 300000 + ",", ",".join(["1"] * 20000), "1,A,2001-2-3,T,B,", "1\n,A,,T,B,", "1,A,2001-02-03\n,T,B,",
]


def test_rejects(spark):
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(LINES)] + [(3, LINES[3], "again")], "line_id long, line string, value string")
    got = dict(map(tuple, rejects.reject_reasons(df).collect()))
    assert got == {i: r for i, s in enumerate(LINES) if (r := reason(s))}
    clean = {r.line_id: r for r in rejects.load_clean(df).collect()}
    assert set(clean) == {i for i, s in enumerate(LINES) if not reason(s)}
    assert clean[4].title == 'T, "q"\nx' and clean[4].doi is None and clean[3].date.isoformat() == "2001-02-03"
    assert rejects.reject_reasons(df.limit(0)).count() == 0 and rejects.load_clean(df.limit(0)).count() == 0
    good = next(s for s in LINES if s and not reason(s))
    bad = next(s for s in LINES if s and reason(s))
    shared = spark.createDataFrame([(7, good), (7, bad), (7, good), (None, good), (None, bad), (8, None)], "line_id long, line string")
    assert sorted(str(r.line_id) for r in rejects.load_clean(shared).collect()) == ["7", "7", "None"]
    assert {(r.line_id, r.reason) for r in rejects.reject_reasons(shared).collect()} == {(7, reason(bad)), (None, reason(bad)), (8, "column_count")}


# orphans


def ts(month, day=1):
    return datetime(2020 + (month - 1) // 12, (month - 1) % 12 + 1, day, 12)


def test_orphans(spark):
    ref = (orphans.Reference("m", "author_id", "paper_id", "author", "author_id"),)
    people = [(1, ts(1), None), (2, ts(3, 15), None), (3, ts(1), ts(4, 10)), (-5, ts(1), None), (9_000_000_000, ts(2), ts(2, 20)), (4, None, None), (6, ts(1), ts(2)), (6, ts(3), None), (None, ts(1), None)]
    rows = [(a, p, t) for a in (1, 2, 3, 4, 6, 7, -5, -6, 9_000_000_000, 4095, 4096, None) for p, t in ((1, ts(2)), (2, ts(3, 20)), (3, ts(4, 10)), (3, ts(4, 10)), (4, ts(30)), (None, ts(3)), (5, None))]
    rows += [(7, 100 + i, ts(2)) for i in range(300)]
    tables = {
        "m": spark.createDataFrame([(*r, "clash") for r in rows], "author_id long, paper_id long, loaded_at timestamp, reason string"),
        "author": spark.createDataFrame(people, "author_id long, loaded_at timestamp, deleted_at timestamp"),
    }
    known = defaultdict(list)
    for a, lo, de in people:
        known[a].append((lo or datetime.min, de or datetime.max))
    want = set()
    for a, p, t in rows:
        if a is None or p is None or t is None:
            continue
        case = lambda why, a=a, p=p, t=t: want.add(("m", "author_id", a, p, t.strftime("%Y-%m"), why))
        if a not in known:
            case("missing")
            continue
        if min(x for x, _ in known[a]) > t:
            case("late")
        if max(x for _, x in known[a]) <= t:
            case("deleted")
    found = orphans.orphans(tables, ref)
    assert Counter(map(tuple, found.collect())) == Counter(want)
    assert {r.n_cases for r in orphans.orphan_report(found).where("reason = 'missing' AND period = '2020-02'").collect()} == {sum(w[5] == "missing" and w[4] == "2020-02" for w in want)}
    assert orphans.orphans({**tables, "m": tables["m"].limit(0)}, ref).count() == 0
    assert {r.reason for r in orphans.orphans({**tables, "author": tables["author"].limit(0)}, ref).collect()} == {"missing"}
    # keys that are no integers go through the dictionary
    named = {
        "m": tables["m"].withColumn("author_id", F.concat(F.lit("A"), "author_id")),
        "author": tables["author"].withColumn("author_id", F.concat(F.lit("A"), "author_id")),
    }
    assert Counter(map(tuple, orphans.orphans(named, ref).collect())) == Counter((*w[:2], f"A{w[2]}", str(w[3]), *w[4:]) for w in want)


def test_words_without_ids_are_not_stored(spark):
    rows = spark.createDataFrame([(0, 1, c) for c in (0, 63, 64, 64, -1, 10**15, 0)], "ref_no int, month int, code long")
    got = {r.word_no: r.bits & (2**64 - 1) for r in orphans.reference_words(rows).collect()}
    assert got == {0: 1 | 1 << 63, 1: 1, -1: 1 << 63, 10**15 >> 6: 1 << (10**15 & 63)}


def test_watched_keys(spark):
    from litweave import runtime

    big = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    df, hot = runtime.watch_keys(big, "k")
    df.write.format("noop").mode("overwrite").save()
    assert set(hot()) == set(runtime.hot_keys(big, "k"))


def test_encode_keys(spark):
    codes = orphans.encode_keys(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string"), spark.createDataFrame([("c",)], "k string")).collect()
    assert {r.key for r in codes} == {"a", "b", "c"} and len({r.code for r in codes}) == 3


# heavy keys


def test_key_profile(spark):
    t = datetime(2020, 1, 1)
    rows = [(1, p % 7, t) for p in range(700)] + [(1, None, None), (2, 5, t), (2, 4, t), (3, None, t), (None, 1, t), (4, -(2**63), t), (5, 2**63 - 1, t), (5, -1, t), (5, -1, t)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k long, p long, at timestamp, n_rows string")
    got = {r.key_id: r for r in heavykeys.key_profile(df, "k", "p", "at").collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for k, r in got.items():
        own = [p for a, p, _ in rows if a == k]
        values = Counter(p for p in own if p is not None)
        mode = min(values, key=lambda p: (-values[p], p)) if values else None
        assert (r.n_rows, r.n_values, r.mode_value, r.mode_rows) == (len(own), len(values), mode, values[mode] if values else None), k
    assert {r.key_id for r in heavykeys.heavy_keys(heavykeys.key_profile(df, "k", "p", "at"), len(rows), 50).collect()} == {1}
    assert heavykeys.key_profile(df.limit(0), "k", "p", "at").count() == 0


def test_hot_keys_join(spark):
    from litweave import runtime

    big = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("y"))
    small = spark.range(0, 60_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).unionByName(spark.createDataFrame([(1, 5), (1, 6)], "k long, x long"))
    hot = runtime.hot_keys(big, "k")
    assert set(hot) == {spark.range(1).select(F.xxhash64(F.lit(1).cast("long"))).first()[0]} and next(iter(hot.values())) == pytest.approx(1 / 3, abs=0.01)
    want = big.join(small, "k").groupBy().agg(F.count("*"), F.sum("x"), F.sum("y")).first()
    joined = runtime.skew_join(big, small, "k")
    assert joined.columns == ["k", "y", "x"] and joined.groupBy().agg(F.count("*"), F.sum("x"), F.sum("y")).first() == want
    null = spark.createDataFrame([(None, None)], "k long, y long")
    assert runtime.skew_join(big.unionByName(null), small, "k", how="left").count() == big.join(small, "k", "left").count() + 1
    alone = big.select("k")  # nothing to salt by: repeated rows stay together
    assert runtime.skew_join(alone, small, "k").count() == want[0]
    text = big.select(F.col("k").cast("string").cast("binary").alias("k"), "y")
    assert runtime.skew_join(text, small.select(F.col("k").cast("string").cast("binary").alias("k"), "x"), "k").count() == want[0]


def test_scratch_removes_what_was_written_inside(spark):
    from litweave import runtime

    with runtime.scratch(spark):
        df = runtime.materialise(spark.range(10), "kept")
        path = df.inputFiles()[0].removeprefix("file:")
        assert Path("/" + path.lstrip("/")).exists() and df.count() == 10
    assert not Path("/" + path.lstrip("/")).exists()


@pytest.mark.parametrize("null", [True, False])
def test_hot_keys_of_nothing(spark, null):
    from litweave import runtime

    df = spark.createDataFrame([(None,)] if null else [], "k long")
    assert runtime.hot_keys(df, "k") == {}
