"""Licence digests do not depend on wrapping, marks and spelling; the SQL finds what the operator finds."""

import textwrap

import duckdb
from tessera.llm import licenses, queries


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["license"] for r in licenses.scan(docs).orderBy("doc_id").collect()]


def wrapped(text, width):
    """The text in another width, its notice lines left alone."""
    parts = [textwrap.fill(" ".join(p.split()), width) if "opyright (c)" not in p else p for p in text.split("\n\n")]
    return "\n\n".join(parts)


def test_wrapping_does_not_matter(spark):
    names = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause"]
    cases = [(n, wrapped(licenses.LICENSES[n], w)) for n in names for w in (40, 60, 72, 79, 10_000)]
    assert scanned(spark, [t for _, t in cases]) == [n for n, _ in cases]


def test_official_layouts_are_found(spark):
    isc = (
        "Copyright (c) 2004-2010 by Internet Systems Consortium\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
        "copyright notice and this permission notice appear in all copies.\n\n" + textwrap.fill(licenses._ISC, 72)
    )
    bullets = licenses.LICENSES["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")
    mit = licenses.LICENSES["MIT"]
    untitled = mit.removeprefix("MIT License\n\n")
    holder = untitled.replace("Copyright (c) <year> <holder>", "Copyright The Example Authors\nAll rights reserved.")
    british = licenses.LICENSES["BSD-3-Clause"].replace("copyright holder", "copyright owner").replace("COPYRIGHT HOLDER", "COPYRIGHT OWNER")
    comment = "\n".join(" * " + x for x in wrapped(mit, 60).split("\n"))
    assert scanned(spark, [isc, bullets, untitled, holder, british, comment, "The MIT License (MIT)\n\n" + untitled]) == ["ISC", "BSD-2-Clause", "MIT", "MIT", "BSD-3-Clause", "MIT", "MIT"]


def test_whole_long_texts_are_found(spark):
    long = [(n, t) for n, t in licenses.texts() if n in {"Apache-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0"}]
    assert {n for n, _ in long} == {"Apache-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0"}
    assert scanned(spark, [" ".join(t.split(" ")).upper() for _, t in long]) == [n for n, _ in long]
    assert scanned(spark, [t + " and more" for _, t in long]) == [None] * len(long)


def test_adjacent_spellings_are_all_mapped(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("licence licence sub licence copyright owner copyright owner", "")], "t string, u string")
    assert rows.select(licenses.canonical(F.col("t"))).first()[0] == "license license sublicense copyright holder copyright holder"


def test_sql_agrees_where_licences_are_found(spark):
    names = ["MIT", "ISC", "BSD-3-Clause"]
    texts = [wrapped(licenses.LICENSES[n], 50) for n in names] + ["no licence licence", "", None, "Copyright notice\n(a) one (b) two\n12. x", "copyright 2020 a\n© b\nall rights reserved here", "x\x0by\x0cz w"]
    docs = spark.createDataFrame([(i % 8, t) for i, t in enumerate(texts)], "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i % 8, t) for i, t in enumerate(texts)])
    want = sorted(map(repr, con.execute(f"select doc_id, digest, license from ({queries.ORACLE['op6_license_scans']})").fetchall()))
    got = sorted(repr(tuple(r)) for r in licenses.scan(docs).select("doc_id", "digest", "license").collect())
    assert got == want and sum("None)" not in x for x in got) == 3


def test_empty_and_long_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, license string, digest string")
    assert licenses.scan(docs).count() == 0
    long = "word " * 200_000
    docs = spark.createDataFrame([(1, long, "x", "y"), (1, long, "x", "y")], "doc_id long, text string, license string, digest string")
    assert [r["license"] for r in licenses.scan(docs).collect()] == [None, None]
