"""From a manifest to documents, an index and an evaluated query file, by the command line."""

import hashlib
import json

import yaml

from evidex.__main__ import main

PROSE = "회사는 보험금을 지급합니다. " * 12
ID = "kyobolife_annuity_plan_policy_terms_20240101_0123abcd"


def test_manifest_to_evaluation(spark, tmp_path, capsys):
    at = lambda name: f"{tmp_path}/{name}"
    body = ("무배당 연금보험(적립형) 약관\n제1조 (목적)\n" + PROSE + "\f제2조 (지급)\n" + PROSE).encode()
    (tmp_path / "원본 1.pdf").write_bytes(body)
    row = {"document_id": ID, "insurer": "kyobolife", "source_file": "원본 1.pdf", "content_hash": hashlib.sha256(body).hexdigest().upper(), "tags": ["t"]}
    listing = lambda **more: (tmp_path / "m.yaml").write_text(yaml.safe_dump({"documents": [row | more]}, allow_unicode=True))
    run = lambda *a: (main(list(a)), capsys.readouterr().out)
    listing(content_hash="0" * 64)
    assert run("ingest", at("m.yaml"), str(tmp_path), at("docs"))[0] == 2
    listing(source_file="none.pdf")
    assert run("ingest", at("m.yaml"), str(tmp_path), at("docs"))[0] == 2
    listing()
    assert run("ingest", at("m.yaml"), str(tmp_path), at("docs")) == (0, "1 documents\n")
    found = json.load(open(at(f"docs/{ID}.json")))
    assert [p["page_number"] for p in found["pages"]] == [1, 2] and found["metadata"]["insurer"] == "kyobolife"
    for a in (("sections", "docs", "sections"), ("chunks", "sections", "chunks"), ("index", "chunks", "index")):
        assert run(a[0], *map(at, a[1:]))[0] == 0
    hit = lambda *flags: {c["section_type"] for c in json.loads(run("search", at("index"), "보험금", *flags)[1]).get("citations", [])}
    assert hit("--document-id", ID, "--include-type", "article", "--insurer", "KyoboLife", "--policy-unit", "연금", "--variant", "적립") == {"article"}
    assert hit("--exclude-type", "article") == set() and hit("--product-name", "nothing") == set() and hit("--all-types") == {"article"}
    query = {"id": "q", "query": "보험금", "expected_any_section_titles": ["제1조 (목적)", "제2조 (지급)"], "filters": {"insurer": "kyobolife"}}
    (tmp_path / "q.yaml").write_text(yaml.safe_dump({"queries": [query]}, allow_unicode=True))
    code, said = run("evaluate", at("index"), at("q.yaml"), "--report", at("report.md"))
    assert code == 0 and "| q | passed | rank 1 | True |" in said and open(at("report.md")).read() == said
    (tmp_path / "q.yaml").write_text(yaml.safe_dump({"queries": [query, query | {"id": "miss", "expected_any_section_titles": ["no such"]}]}, allow_unicode=True))
    code, said = run("evaluate", at("index"), at("q.yaml"))
    assert code == 1 and "| miss | failed | no | True |" in said and "## miss" in said
    assert run("evaluate", at("index"), at("q.yaml"), "--allow-misses")[0] == 0
    assert run("evaluate", at("index"), at("none.yaml"))[0] == 2
