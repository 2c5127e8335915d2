import pytest

from marlstone.errors import InvalidValueError
from marlstone.plans.schema import Field, Schema, default_schema, matched, valid_name


def test_default_names():
    s = default_schema()
    kinds = {n: s.resolve(n).type for n in ("body_text", "text", "size_num", "num", "made_time", "a_tag", "tag", "a_url", "a_cat", "at_lonlat", "id", "type", "_meta", "other")}
    assert kinds == {
        "body_text": "text", "text": "text", "size_num": "double", "num": "double", "made_time": "timestamp", "a_tag": "exact", "tag": "exact", "a_url": "exact",
        "a_cat": "cat", "at_lonlat": "lonlat", "id": "id", "type": "exact", "_meta": "meta", "other": "text",
    }
    assert s.fields["body_text"].group == "tbody" and s.fields["body_text"].store_field == "body_text"
    assert s.fields["other"].store_field == "other" and s.fields["other"].processor == ""


def test_patterns():
    assert matched("*_num", "x_num") == "x" and matched("num", "num") == "" and matched("num", "xnum") is None
    with pytest.raises(InvalidValueError):
        Schema.of({"patterns": [["a*", {"type": "double"}]]})


def test_a_field_cannot_change():
    s = Schema.of({"fields": {"a": {"type": "exact", "group": "g"}}})
    s.merge({"fields": {"a": {"type": "exact", "group": "g"}, "b": {"type": "double"}}})
    with pytest.raises(InvalidValueError):
        s.merge({"fields": {"a": {"type": "double"}}})
    assert Schema.of(s.to_json()).to_json() == s.to_json()


@pytest.mark.parametrize("config", [{"type": "exact"}, {"type": "text", "group": "a\tb"}, {"type": "id", "max_length": 241}, {"type": "exact", "group": "g", "too_long_action": "x"}, {"type": "none"}, {"type": "stored"}])
def test_wrong_fields(config):
    with pytest.raises(InvalidValueError):
        Field.of(config)


def test_names():
    assert valid_name("ab c") == "ab c"
    for bad in ("", "a/b", "a.b", "a,b", "a[b", "a\\b", "a:b", "a{", "a\x01"):
        with pytest.raises(InvalidValueError):
            valid_name(bad)


def test_unknown_stemmers_are_refused():
    import pytest

    from marlstone.errors import InvalidValueError
    from marlstone.plans.schema import Field

    assert Field.of({"type": "text", "group": "t", "processor": "stem_english"}).processor == "stem_english"
    for processor in ("stem_fr", "stem_", "stemmer"):
        with pytest.raises(InvalidValueError):
            Field.of({"type": "text", "group": "t", "processor": processor})
