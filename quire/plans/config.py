"""Settings. One table for each command names them, with their defaults and what they may be; values, messages and the file of
defaults all follow from it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any, ClassVar

EFFORTS = ("low", "medium", "high", "xhigh", "max")


@dataclass(frozen=True)
class Rule:
    """A setting: its default, the test that a value must pass, and that test in words."""

    default: Any
    fits: Callable[[Any], bool]
    words: str


def _switch(default: bool) -> Rule:
    return Rule(default, lambda v: isinstance(v, bool), "true or false")


def _count(default: int, least: int) -> Rule:
    return Rule(default, lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= least, f"a whole number from {least}")


def _part(default: float) -> Rule:
    return Rule(default, lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and 0 < v < 1, "a number between 0 and 1")


class Settings:
    """Values of a table of rules; what a file says beyond the table is listed in `unknown`."""

    RULES: ClassVar[dict[str, Rule]] = {}
    #: What must hold between settings: a test of the values, and its words.
    TOGETHER: ClassVar[tuple[tuple[Callable[[dict], bool], str], ...]] = ()

    def __init__(self, origin: Path | None = None, **given: Any):
        values = {name: given.get(name, rule.default) for name, rule in self.RULES.items()}
        wrong = [f"{name}: {v!r} is not {self.RULES[name].words}" for name, v in values.items() if not self.RULES[name].fits(v)]
        wrong = wrong or [words for holds, words in self.TOGETHER if not holds(values)]
        if wrong:
            raise ValueError("; ".join(wrong) + (f" ({origin})" if origin else ""))
        self.values, self.origin, self.unknown = values, origin, tuple(sorted(map(str, given.keys() - values.keys())))

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.values == other.values

    __hash__ = None

    def but(self, **changes: Any) -> Settings:
        """The same with some values changed."""
        return type(self)(self.origin, **{**self.values, **changes})


class ConvertConfig(Settings):
    RULES = {"extract_images": _switch(True), "min_image_pixels": _count(10_000, 0), "max_image_bytes": _count(10_485_760, 0), "download_remote_images": _switch(False)}


class SummaryConfig(Settings):
    RULES = {
        "model": Rule("gpt-5.4", lambda v: isinstance(v, str) and v.strip() != "", "a model's name"),
        "effort": Rule("high", lambda v: v in EFFORTS, "one of " + ", ".join(EFFORTS)),
        "max_tokens": _count(16_000, 1),
        "chapter_threshold_words": _count(20_000, 0),
        "target_ratio": _part(0.10),
        "min_ratio": _part(0.05),
        "max_ratio": _part(0.15),
        "min_words": _count(150, 0),
        "carry_context": _switch(True),
    }
    TOGETHER = ((lambda v: v["min_ratio"] <= v["max_ratio"], "min_ratio is above max_ratio"),)

    def ratios(self) -> dict:
        return {"ratio": self.target_ratio, "least_ratio": self.min_ratio, "most_ratio": self.max_ratio, "least": self.min_words}


def found(file_name: str) -> Path | None:
    """The file of this name that counts: the working folder's before the user's."""
    return next(filter(Path.is_file, (base / file_name for base in (Path.cwd(), Path.home() / ".config"))), None)


def read(kind: type[Settings], file_name: str, explicit: Path | None = None) -> Settings:
    """Settings from the file named, or else from the one that is found, or else the defaults. ValueError where that cannot be done."""
    path = explicit or found(file_name)
    if path is None:
        return kind()
    import yaml

    try:
        given = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as e:
        raise ValueError(f"settings of {path} are unreadable: {e}") from e
    if not isinstance(given or {}, Mapping):
        raise ValueError(f"settings of {path}: names with values are expected, not a {type(given).__name__}")
    return kind(Path(path), **{str(k): v for k, v in (given or {}).items()})


def default_text(kind: type[Settings]) -> str:
    """A file of all defaults, each under what it may be."""
    say = lambda v: {True: "true", False: "false"}[v] if isinstance(v, bool) else str(v)
    return "".join(f"# {rule.words}\n{name}: {say(rule.default)}\n" for name, rule in kind.RULES.items())


def provide(kind: type[Settings], file_name: str) -> Path | None:
    """Writes the defaults to the working folder where no file is found; the path, if so."""
    if found(file_name) is not None:
        return None
    path = Path.cwd() / file_name
    path.write_text(default_text(kind), encoding="utf-8")
    return path
