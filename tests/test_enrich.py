from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.operators import enrich
from graphloom.sources import rdfxml

XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:e="http://e/" xml:base="http://b/o" xml:lang="en">
 <owl:Class rdf:about="#A" e:note="n"><e:label>Ay</e:label><e:size rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">3</e:size>
  <e:sub rdf:resource="http://x/y"/><e:of><owl:Restriction><e:on rdf:nodeID="q"/></owl:Restriction></e:of>
  <e:list rdf:parseType="Collection"><owl:Class rdf:about="http://x/1"/><rdf:Description rdf:ID="two"/></e:list></owl:Class>
</rdf:RDF>"""


def test_rdfxml(spark, tmp_path):
    rows = {(s, p, o): (sk, ok, dt, lang) for s, p, o, sk, ok, dt, lang in rdfxml.parse_rdfxml(XML, "f")}
    assert rows["http://b/o#A", T.TYPE, T.OWL + "Class"] == ("iri", "iri", "", "")
    assert rows["http://b/o#A", "http://e/label", "Ay"] == ("iri", "lit", "", "en")
    assert rows["http://b/o#A", "http://e/size", "3"] == ("iri", "lit", T.XSD + "integer", "")
    assert len(rows) == 14 and sum(p == T.RDF + "first" for _, p, _ in rows) == 2
    (tmp_path / "a.owl").write_text(XML)
    (tmp_path / "b.ttl").write_text("@prefix e: <http://e/> . e:x e:y 1 .")
    (tmp_path / "c.xml").write_text("<broken")
    assert rdfxml.read_rdf(spark, f"file://{tmp_path}", "PERMISSIVE").count() == 15


def test_enrichment(spark):
    t = spark.createDataFrame([("a", "same", "http://m/work/123", "iri", "iri", "", ""), ("a", "same", "http://w/Q5", "iri", "iri", "", ""), ("b", "id", "7", "iri", "lit", "", "")], T.TRIPLE_SCHEMA)
    assert [tuple(r) for r in enrich.external_ids(t, "same", {"m": r"work/(\d+)", "q": r"/(Q\d+)$"}).collect()] == [("a", "123", "Q5")]
    assert sorted(tuple(r) for r in enrich.first_by_priority(t, ["id", "same"]).collect()) == [("a", "http://m/work/123"), ("b", "7")]
    known = spark.createDataFrame([("1", "http://e/ann")], "id string, node string")
    rows = spark.createDataFrame([("1", "Ann"), ("2", "Ann"), ("3", "Bo b")], "id string, name string")
    assert sorted((r.id, r.node) for r in enrich.reuse_or_mint(rows, known, "http://e/").collect()) == [("1", "http://e/ann"), ("2", "http://e/ann_2"), ("3", "http://e/bo-b")]
    m = spark.createDataFrame([("p", "b", "1970", "1985-07", ["Bass", "bass ", ""])], "member string, band string, begin string, end string, instruments array<string>")
    out = enrich.memberships(m, "http://e/")
    assert out.count() == 6 and out.filter(F.col("p") == "http://e/end").first().o_dt == T.XSD + "gYearMonth"
    js = '{"claims": {"P1": [{"mainsnak": {"datavalue": {"value": "x"}}}, {"mainsnak": {"datavalue": {"value": {"id": "Q9"}}}}, {"mainsnak": {}}]}}'
    e = spark.createDataFrame([("E", js), ("F", "{}")], "entity string, body string")
    assert sorted(tuple(r) for r in enrich.claims(e, "body", "P1").select("value").collect()) >= [("Q9",)]
    s = spark.range(1).select(enrich.candidate_slugs(F.lit("Radio Ga Ga (Live)"), F.lit("Queen")).alias("s")).first().s
    assert s == ["queen-radio-ga-ga-live", "queen-radio-ga-ga", "radio-ga-ga"]
