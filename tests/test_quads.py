import json

import pytest

from graphloom.plans.parser import QueryError
from graphloom.sources.datasource import FIELDS, RdfSource, parse_file, read_quads
from graphloom.sources.quads import parse_jsonld, parse_trig
from graphloom.terms import RDF, XSD

X = "http://x/"
TRIG = """@prefix x: <http://x/> .
x:a x:p "one", "zwei"@de ; x:q 5 .
x:g1 { x:a x:p x:b . x:b x:p [ x:q "inner" ] }
GRAPH <http://x/g2> { x:l x:items ( x:a x:b ) . }
{ x:c a x:D }
"""
DOC = {
    "@context": {"x": X, "name": "x:name", "knows": {"@id": "x:knows", "@type": "@id"}, "born": {"@id": "x:born", "@type": XSD + "date"}, "tags": {"@id": "x:tags", "@container": "@list"}, "label": {"@id": "x:label", "@container": "@language"}, "child": {"@reverse": "x:parent"}},
    "@id": "x:ann", "@type": ["x:Person"], "name": "Ann", "unknown": "dropped", "knows": ["x:bob", {"@id": "_:n1", "name": {"@value": "N", "@language": "EN"}}], "born": "2001-02-03",
    "tags": ["t", 2, 1.5, True], "label": {"de": "A", "en": ["B", "C"]}, "child": {"@id": "x:kid"}, "x:none": None, "x:age": {"@value": "7", "@type": "x:years"},
}


def short(rows):
    out = set()
    for s, p, o, sk, ok, dt, lang, g in rows:
        name = lambda v, k: ("_" if k == "bnode" else v.replace(X, "x:").replace(RDF, "rdf:").replace(XSD, "xsd:"))
        out.add((name(s, sk), name(p, "iri"), name(o, ok), name(dt, "iri") or lang, name(g, "iri")))
    return out


def test_trig():
    rows = parse_trig(TRIG, "f")
    assert short(rows) == {
        ("x:a", "x:p", "one", "", ""), ("x:a", "x:p", "zwei", "de", ""), ("x:a", "x:q", "5", "xsd:integer", ""), ("x:a", "x:p", "x:b", "", "x:g1"), ("x:b", "x:p", "_", "", "x:g1"), ("_", "x:q", "inner", "", "x:g1"),
        ("x:l", "x:items", "_", "", "x:g2"), ("_", "rdf:first", "x:a", "", "x:g2"), ("_", "rdf:rest", "_", "", "x:g2"), ("_", "rdf:first", "x:b", "", "x:g2"), ("_", "rdf:rest", "rdf:nil", "", "x:g2"), ("x:c", "rdf:type", "x:D", "", ""),
    }
    for bad in ("<a> <b> .", "<g> { <a> <b> <c>", "<g> { <a> <b> <c> <d> <e> <f> }"):
        with pytest.raises((QueryError, IndexError)):
            parse_trig(bad)


def test_jsonld():
    rows = parse_jsonld(json.dumps(DOC), "f")
    assert short(rows) == {
        ("x:ann", "rdf:type", "x:Person", "", ""), ("x:ann", "x:name", "Ann", "", ""), ("x:ann", "x:knows", "x:bob", "", ""), ("x:ann", "x:knows", "_", "", ""), ("_", "x:name", "N", "en", ""), ("x:ann", "x:born", "2001-02-03", "xsd:date", ""),
        ("x:ann", "x:tags", "_", "", ""), ("_", "rdf:first", "t", "", ""), ("_", "rdf:first", "2", "xsd:integer", ""), ("_", "rdf:first", "1.5E0", "xsd:double", ""), ("_", "rdf:first", "true", "xsd:boolean", ""), ("_", "rdf:rest", "_", "", ""), ("_", "rdf:rest", "rdf:nil", "", ""),
        ("x:ann", "x:label", "A", "de", ""), ("x:ann", "x:label", "B", "en", ""), ("x:ann", "x:label", "C", "en", ""), ("x:kid", "x:parent", "x:ann", "", ""), ("x:ann", "x:age", "7", "x:years", ""),
    }


def test_jsonld_graphs_and_contexts():
    doc = {"@context": {"@vocab": X, "@base": "http://b/c/", "@language": "fr"}, "@graph": [{"@id": "one", "p": "texte"}, {"@id": "#g", "@graph": {"@id": "../two", "p": {"@id": "three"}}, "q": {"@set": [1, 2]}}]}
    assert short(parse_jsonld(json.dumps(doc))) == {
        ("http://b/c/one", "x:p", "texte", "fr", ""), ("http://b/two", "x:p", "http://b/c/three", "", "http://b/c/#g"), ("http://b/c/#g", "x:q", "1", "xsd:integer", ""), ("http://b/c/#g", "x:q", "2", "xsd:integer", ""),
    }
    inner = [{"@context": {"k": X + "k"}, "@id": X + "a", "k": {"@context": {"k": X + "other"}, "k": "deep"}}, {"@id": X + "b", X + "k": {"@list": []}}]
    assert short(parse_jsonld(json.dumps(inner))) == {("x:a", "x:k", "_", "", ""), ("_", "x:other", "deep", "", ""), ("x:b", "x:k", "rdf:nil", "", "")}
    for bad in ("{", "7", json.dumps({"@context": "http://remote"}), json.dumps({"@nest": {}})):
        with pytest.raises(QueryError):
            parse_jsonld(bad)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.trig").write_text(TRIG)
    (tmp_path / "sub" / "b.jsonld").write_text(json.dumps(DOC))
    (tmp_path / "c.ttl").write_text("<http://x/s> <http://x/p> 'v' .")
    (tmp_path / "d").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/"><rdf:Description rdf:about="http://x/r"><x:p>text</x:p></rdf:Description></rdf:RDF>')
    (tmp_path / "_hidden.ttl").write_text("bad")
    return tmp_path


def test_read_and_write(spark, folder, tmp_path):
    spark.dataSource.register(RdfSource)
    df = spark.read.format("rdf").option("partitionBytes", "200").load(str(folder))
    rows = df.collect()
    assert df.columns == FIELDS and len(rows) == len(parse_trig(TRIG)) + len(parse_jsonld(json.dumps(DOC))) + 2 and all(r.error is None for r in rows)
    assert df.rdd.getNumPartitions() >= 3
    again = read_quads(spark, f"file://{folder}", glob="[a-z]*").drop("file")
    assert short(tuple(r)[:8] for r in again.collect()) == short(tuple(r)[:8] for r in rows)
    out = f"{tmp_path}/out"
    df.write.format("rdf").mode("append").save(out)
    back = spark.read.format("rdf").load(out)
    content = lambda d: sorted(tuple(r)[:8] for r in d.collect())
    assert content(back) == content(df)  # blank nodes keep their names
    df.limit(3).write.format("rdf").mode("overwrite").save(out)
    assert spark.read.format("rdf").load(out).count() == 3


def test_a_bad_file_is_one_row(spark, folder):
    spark.dataSource.register(RdfSource)
    good = spark.read.format("rdf").load(str(folder)).count()
    (folder / "bad.ttl").write_text("<a> is no turtle")
    read = lambda mode: spark.read.format("rdf").option("mode", mode).load(str(folder))
    bad = read("PERMISSIVE").filter("error is not null").collect()
    assert [r.file.endswith("bad.ttl") and r.s is None for r in bad] == [True] and read("PERMISSIVE").count() == good + 1
    assert read("DROPMALFORMED").count() == good
    with pytest.raises(Exception, match="bad.ttl"):
        read("FAILFAST").collect()


def test_forms_are_tried():
    assert parse_file(TRIG, "x.ttl") == parse_trig(TRIG, "x.ttl")
    assert parse_file(json.dumps(DOC), "x") == parse_jsonld(json.dumps(DOC), "x")
