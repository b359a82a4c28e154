"""A summarizer over any transport.

What a model may refuse is held as ladders: the names under which a parameter is offered, best first, and at last nothing. A refusal
takes the ladder it names one step down, for this client's lifetime, so every request asks for what the model is known to take.

`send` takes the parameters of one request and gives a Reply, or raises Refused with the service's message. A client is made
in each Python worker, so that connections are not pickled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from quire.functions import text as T
from quire.plans.config import SummaryConfig

# The services' names of what may be refused, and the mark of a cut answer.
LADDERS = {"limit": ("max_completion_tokens", "max_tokens"), "effort": ("reasoning_effort",)}
REFUSALS = re.compile(r"(?i)unsupported|not supported")
TRUNCATED = "\n\n*[summary truncated: hit the token limit — raise max_tokens]*"


class Refused(Exception):
    """The service rejects a request's parameters."""


class Failed(Exception):
    """What a user should read."""


@dataclass
class Reply:
    text: str
    finish: str = "stop"
    input_tokens: int = 0
    output_tokens: int = 0

    def answer(self) -> str:
        """The text, marked where it was cut."""
        body = self.text.strip()
        match bool(body), self.finish:
            case False, "length":
                raise Failed("all tokens went before any text came; a larger max_tokens (token limit) may help")
            case False, "content_filter":
                raise Failed("a content filter held the answer back")
            case False, _:
                raise Failed("the answer is empty")
            case True, "length":
                return body + TRUNCATED
        return body


@dataclass
class Client:
    cfg: SummaryConfig
    send: Callable[[dict], Reply]
    steps: dict[str, int] = field(default_factory=lambda: dict.fromkeys(LADDERS, 0))

    def offered(self) -> dict[str, str]:
        """Ladder by the name under which it is offered now."""
        return {LADDERS[k][i]: k for k, i in self.steps.items() if i < len(LADDERS[k])}

    def parameters(self, system: str, user: str) -> dict:
        values = {"limit": self.cfg.max_tokens}
        if re.match(T.REASONING_MODEL, self.cfg.model.strip()):
            values["effort"] = T.EFFORTS.get(self.cfg.effort, "medium")
        said = [{"role": role, "content": text} for role, text in (("system", system), ("user", user))]
        return {"model": self.cfg.model, "messages": said, "stream": True} | {name: values[k] for name, k in self.offered().items() if k in values}

    def refused(self, message: str, sent: dict) -> str | None:
        """The ladder that a refusal names, by the name it was sent under."""
        named = [k for name, k in self.offered().items() if name in sent and name in message.lower()]
        return named[0] if named and REFUSALS.search(message) else None

    def complete(self, system: str, user: str, text: str = "", target_words: int = 0) -> tuple[str, int, int]:
        sent = self.parameters(system, user)
        try:
            reply = self.send(sent)
        except Refused as e:
            ladder = self.refused(str(e), sent)
            if ladder is None:
                raise Failed(f"the service rejected the request: {e}") from e
            self.steps[ladder] += 1
            return self.complete(system, user, text, target_words)  # as often as ladders have steps
        return reply.answer(), reply.input_tokens, reply.output_tokens
