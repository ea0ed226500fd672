import re

import pytest

from verdigris.operators.matcher import Matcher, required
from verdigris.operators.rules import rules_of
from verdigris.plans.rules import examples


@pytest.mark.parametrize("pattern, needs", [
    ("(?i)(?:温室气体|GHG|碳|CO2)(?:排放)?强度", {"强度"}), ("a(?:bc|de)?f+", {"a"}), ("(?:water|Energy)\\s+use", {"water", "energy"}), ("x*[0-9]", None), ("(?:ab|c*)", None), ("[甲乙]", {"甲", "乙"}), ("(?=long)ab", {"ab"}),
])
def test_what_a_match_must_hold(pattern, needs):
    found = required(pattern)
    assert found == (None if needs is None else frozenset(needs))


def test_every_match_is_found_by_its_literals():
    rules = rules_of(("unit", "end", "phrase", "english"))
    matcher = Matcher([r.pattern for r in rules], [r.hint for r in rules])
    assert len(matcher.always) < len(rules) / 10
    for text, _ in examples():
        text = text.replace("{v}", "12.5")
        tried = set(matcher.named(text))
        assert {i for i, r in enumerate(rules) if re.search(r.pattern, text) and r.hint.lower() in text.lower()} <= tried
        assert len(tried) < len(rules) / 3


def test_no_patterns_and_no_literals():
    assert Matcher([]).named("text") == []
    assert Matcher(["[0-9]"]).named("") == [0]
    assert Matcher(["abc", "ABD"]).named("xabd") == [1] or Matcher(["(?i)abd"]).named("xABD") == [0]
