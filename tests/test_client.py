import pytest

from quire.plans.client import TRUNCATED, Client, Failed, Refused, Reply
from quire.plans.config import SummaryConfig


def test_refused_parameters_are_dropped_and_remembered():
    seen = []

    def send(p):
        seen.append(set(p))
        for name in ("max_completion_tokens", "reasoning_effort"):
            if name in p:
                raise Refused(f"Unsupported parameter: '{name}' is not supported")
        return Reply(" answer ", input_tokens=3, output_tokens=2)

    c = Client(SummaryConfig(model="gpt-5-x"), send)
    assert c.complete("s", "u") == ("answer", 3, 2) and c.offered() == {"max_tokens": "limit"}
    assert c.complete("s", "u")[0] == "answer" and len(seen) == 4 and "max_tokens" in seen[-1]


@pytest.mark.parametrize("model, effort, sent", [("o3-mini", "max", "high"), ("GPT-5", "low", "low"), ("gpt-4.1", "high", None)])
def test_effort(model, effort, sent):
    assert Client(SummaryConfig(model=model, effort=effort), None).parameters("s", "u").get("reasoning_effort") == sent


def test_answers_are_checked():
    for finish, said in (("length", "token limit"), ("content_filter", "filter"), ("stop", "empty")):
        with pytest.raises(Failed, match=said):
            Client(SummaryConfig(), lambda p, f=finish: Reply(" ", f)).complete("s", "u")
    assert Client(SummaryConfig(), lambda p: Reply("x", "length")).complete("s", "u")[0] == "x" + TRUNCATED

    def never(p):
        raise Refused("bad request")

    with pytest.raises(Failed, match="rejected"):
        Client(SummaryConfig(), never).complete("s", "u")

    def always(p):
        raise Refused(f"unsupported: {' '.join(p)}")

    with pytest.raises(Failed):
        Client(SummaryConfig(), always).complete("s", "u")
    c = Client(SummaryConfig(model="o3"), None)
    sent = c.parameters("s", "u")
    assert c.refused("reasoning_effort is not supported", sent) == "effort" and c.refused("Unsupported: MAX_COMPLETION_TOKENS", sent) == "limit"
    assert c.refused("reasoning_effort is bad", sent) is None and c.refused("temperature is not supported", sent) is None
