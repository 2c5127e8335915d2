import json

from marlstone.__main__ import main
from marlstone.collection import Engine


def test_search_and_train(spark, tmp_path, capsys):
    c = Engine(spark, f"file://{tmp_path}/data").collection("c")
    c.put({"id": 1, "a_num": 5})
    c.commit()
    (tmp_path / "q.json").write_text('{"query": {"field": ["a_num", "range", [1, 9]]} /* any */}')
    main(["search", "-d", f"file://{tmp_path}/data", "-n", "c", "-f", str(tmp_path / "q.json")])
    assert json.loads(capsys.readouterr().out)["items"] == [{"a_num": [5], "id": [1]}]
    (tmp_path / "t").mkdir()
    for label, sample in (("en", "hello world"), ("fr", "bonjour monde")):
        (tmp_path / f"t/text_{label}").write_text(sample)
    main(["train", "-d", str(tmp_path / "t"), "-l", "en"])
    assert list(json.loads(capsys.readouterr().out)["profiles"]) == ["en"]
