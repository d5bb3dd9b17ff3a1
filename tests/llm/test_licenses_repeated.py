"""Notices that stand close together."""

from tidemark.llm import licenses


def test_a_weaker_match_before_the_best_is_found():
    notice = max((n for n in licenses.NOTICES if len(n) >= 2 * licenses.PER_ERROR), key=len)
    weak = notice[:5] + notice[6:]
    text = f"{weak} {notice} {weak}"
    got = [x for x in licenses.fuzzy(text) if x[2] == licenses.NOTICES[notice]]
    at = len(weak) + 1
    assert any(x[3] == 0 and (x[0], x[1]) == (at, at + len(notice)) for x in got)
    assert any(x[1] <= at for x in got) and any(x[0] >= at + len(notice) for x in got)
