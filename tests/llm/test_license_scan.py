import pytest

from quern.llm import license_scan as L


@pytest.fixture(scope="module")
def license_rows(rows):
    grant, header = L.TEMPLATES["MIT-grant"], L.TEMPLATES["Apache-2.0-header"]
    changed = header.split()
    changed[20] = "OTHER"
    long = " ".join(f"w{i}" for i in range(3000))
    return rows + [
        (300, f"{long} {grant} {long}"), (301, f"x\nReleased under   the MIT license!\ny"), (302, " ".join(changed)),
        (303, "Released under the MIT"), (304, grant[: len(grant) // 2]), (305, grant.upper()), (306, f"{grant} {long} {grant}"),
        (307, " ".join(t for n, t in L.TEMPLATES.items() if n != "MIT")), (309, f"{long}\n{L.TEMPLATES['MIT']}"),
        (310, f"{L.TEMPLATES['BSD-2-Clause']}\n\n{L.TEMPLATES['Zlib']}"), (308, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
    ]


def test_scan_is_brute_force(spark, license_rows, scratch):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in license_rows], "doc_id long, text string, license string, band int").repartition(4)
    got = [(r.doc_id, r.license) for r in L.scan(docs, scratch).collect()]
    assert len(got) == len(set(got))
    assert set(got) == L.brute_force(license_rows)
    assert {(300, "MIT-grant"), (301, "MIT-notice"), (302, "Apache-2.0-header"), (308, "CC-BY-NC-4.0-notice")} <= set(got)
    assert not {(303, "MIT-notice"), (304, "MIT-grant")} & set(got)
    assert {i for i, n in got if n == "MIT"} == {309} and {(310, "BSD-2-Clause"), (310, "Zlib")} <= set(got)
    joined = [(r.doc_id, r.license, r.containment, r.first_shingle) for r in L.scan(docs, scratch, inline=0).collect()]
    assert sorted(joined, key=str) == sorted([(r.doc_id, r.license, r.containment, r.first_shingle) for r in L.scan(docs, scratch).collect()], key=str)


def test_corpus_notices_are_found(spark):
    directory = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.license) for r in L.op1_license_scan(spark, directory).collect()}
    docs = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text").collect()
    for line, name in (("Released under the MIT License.", "MIT-notice"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0-notice"), ("GNU General Public License, version 3.", "GPL-3.0-notice")):
        held = {r.doc_id for r in docs if line in r.text}
        assert held and held == {d for d, n in got if n == name}


def test_bad_templates_and_nothing(spark, empty, scratch):
    with pytest.raises(ValueError):
        L.scan(empty, scratch, {"short": "only four words here"})
    assert L.scan(empty, scratch).collect() == []
