"""Settings: what is checked where. Driver-side values that become literals in a plan.

Globs follow the plain dialect: `*` and `?` also cross `/`, `**` between separators is any number of
directories, `[...]` a class; no braces. An invalid glob or pattern fails when settings are read.
"""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_DICTIONARY, DEFAULT_MIN_LENGTH = "en_us", 3
FILE_NAMES = ("quillspark.toml", ".quillspark.toml")


class SettingsError(ValueError):
    pass


def fold(word: str) -> str:
    return word.casefold()


def glob_regex(glob: str) -> str:
    """A Java and Python regular expression that matches whole paths."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            if (i and glob[i - 1] != "/") or (i + 2 < len(glob) and glob[i + 2] != "/"):
                raise SettingsError(f"invalid glob pattern '{glob}': ** stands between separators")
            if i + 2 < len(glob):
                out.append("(?:.*/)?")
                i += 3
            else:
                out.append(".*")
                i += 2
            continue
        if c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise SettingsError(f"invalid glob pattern '{glob}': no end of a class")
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] == '!' else body}]")
            i = end
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def glob_matches(glob: str, path: str) -> bool:
    """At run time an invalid glob matches nothing."""
    try:
        return re.match(glob_regex(glob), path) is not None
    except SettingsError:
        return False


def path_matches(path: Column, globs: tuple[str, ...], windows: bool = False) -> Column:
    """Whether any glob matches; one regular expression, so it can sit in a scan's filter."""
    path = F.replace(path, F.lit("\\"), F.lit("/")) if windows else path
    good = []
    for g in globs:
        try:
            good.append(f"(?:{glob_regex(g)})")
        except SettingsError:
            continue
    return F.coalesce(path.rlike("|".join(good)), F.lit(False)) if good else F.lit(False)


def tag_matches(tag: str, pattern: str) -> bool:
    return tag == pattern or tag.startswith(pattern + ".")


LISTS = ("dictionaries", "words", "flag_words", "ignore_patterns")


@dataclass(frozen=True)
class Override:
    """Settings for some paths: None leaves a list alone, an empty list empties it."""

    paths: tuple[str, ...] = ()
    dictionaries: tuple[str, ...] | None = None
    words: tuple[str, ...] | None = None
    flag_words: tuple[str, ...] | None = None
    ignore_patterns: tuple[str, ...] | None = None
    extra_dictionaries: tuple[str, ...] | None = None
    extra_words: tuple[str, ...] | None = None
    extra_flag_words: tuple[str, ...] | None = None
    extra_ignore_patterns: tuple[str, ...] | None = None

    def has_effect(self) -> bool:
        return bool(self.paths) and any(getattr(self, f.name) is not None for f in fields(self)[1:])

    def matches(self, path: str) -> bool:
        return any(glob_matches(g, path) for g in self.paths)


def ascii_lower(word: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in word)


def distinct(items: list[str], key=lambda x: x) -> tuple[str, ...]:
    """Sorted by key, then as they are; the first of equal keys stays."""
    out: dict[str, str] = {}
    for x in sorted(items, key=lambda x: (key(x), x)):
        out.setdefault(key(x), x)
    return tuple(out.values())


@dataclass(frozen=True)
class Settings:
    dictionaries: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    flag_words: tuple[str, ...] = ()
    include_paths: tuple[str, ...] = ()
    ignore_paths: tuple[str, ...] = ()
    ignore_patterns: tuple[str, ...] = ()
    use_global: bool = True
    min_word_length: int | None = None
    include_tags: tuple[str, ...] = ()
    exclude_tags: tuple[str, ...] = ()
    overrides: tuple[Override, ...] = field(default=())

    # accessors
    def dictionary_ids(self) -> tuple[str, ...]:
        return self.dictionaries or (DEFAULT_DICTIONARY,)

    def min_length(self) -> int:
        return DEFAULT_MIN_LENGTH if self.min_word_length is None else self.min_word_length

    def allows(self, word: str) -> bool:
        return fold(word) in {fold(x) for x in self.words}

    def flags(self, word: str) -> bool:
        return fold(word) in {fold(x) for x in self.flag_words}

    def ignores(self, path: str) -> bool:
        return any(glob_matches(g, path) for g in self.ignore_paths)

    def includes(self, path: str) -> bool:
        return not self.include_paths or any(glob_matches(g, path) for g in self.include_paths)

    def checks_tag(self, tag: str) -> bool:
        if any(tag_matches(tag, p) for p in self.exclude_tags):
            return False
        return not self.include_tags or any(tag_matches(tag, p) for p in self.include_tags)

    # algebra
    def merged(self, other: Settings) -> Settings:
        """This one (global) with another (project) on top; use_global stays this one's."""
        both = lambda name, key=lambda x: x: distinct([*getattr(self, name), *getattr(other, name)], key)
        return replace(
            self,
            **{n: both(n) for n in ("dictionaries", "include_paths", "ignore_paths", "include_tags", "exclude_tags")},
            **{n: both(n, fold) for n in ("words", "flag_words")},
            ignore_patterns=self.ignore_patterns + other.ignore_patterns,
            overrides=self.overrides + other.overrides,
            min_word_length=self.min_word_length if other.min_word_length is None else other.min_word_length,
        )

    def resolved(self, path: str) -> Settings:
        """With all overrides for a path applied in order: replace, then append."""
        out: dict[str, Any] = {n: getattr(self, n) for n in LISTS}
        for block in self.overrides:
            if block.matches(path):
                for n in LISTS:
                    own, extra = getattr(block, n), getattr(block, f"extra_{n}")
                    out[n] = (out[n] if own is None else own) + (extra or ())
        return replace(self, **out, overrides=())

    def all_dictionary_ids(self) -> tuple[str, ...]:
        """Those of the base and of every override, whatever its paths."""
        more = [x for o in self.overrides for part in (o.dictionaries, o.extra_dictionaries) for x in part or ()]
        return distinct([*self.dictionary_ids(), *more])

    def with_item(self, name: str, item: str) -> tuple[Settings, bool]:
        """With a word or path in a list, and whether it is new; words compare folded."""
        key = fold if name in ("words", "flag_words") else (lambda x: x)
        now = getattr(self, name)
        if key(item) in {key(x) for x in now}:
            return self, False
        return replace(self, **{name: distinct([*now, item], key)}), True


def _strings(value: Any, name: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise SettingsError(f"{name} is a list of strings")
    return tuple(value)


def _patterns(value: Any, name: str) -> tuple[str, ...]:
    import regex

    for p in (out := _strings(value, name)):
        try:
            regex.compile(f"(?m){p}")
        except regex.error as e:
            raise SettingsError(f"invalid pattern '{p}': {e}") from e
    return out


def _override(raw: Any) -> Override:
    if not isinstance(raw, dict):
        raise SettingsError("an override is a table")
    out: dict[str, Any] = {}
    for f in fields(Override):
        if f.name in raw:
            read = _patterns if f.name.endswith("ignore_patterns") else _strings
            value = read(raw[f.name], f.name)
            if f.name == "paths":
                for g in value:
                    glob_regex(g)
            elif not f.name.endswith("ignore_patterns"):
                value = tuple(ascii_lower(x) for x in value)
            out[f.name] = value
    return Override(**out)


def parse(text: str) -> Settings:
    """Settings from TOML. Overrides without paths or effect are dropped; unknown keys are ignored."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise SettingsError(str(e)) from e
    out: dict[str, Any] = {}
    for f in fields(Settings):
        if f.name not in raw:
            continue
        value = raw[f.name]
        if f.name == "overrides":
            out[f.name] = tuple(o for o in map(_override, value) if o.has_effect())
        elif f.name == "use_global":
            out[f.name] = bool(value)
        elif f.name == "min_word_length":
            if not isinstance(value, int) or value < 0:
                raise SettingsError("min_word_length is a number from 0 on")
            out[f.name] = value
        elif f.name == "ignore_patterns":
            out[f.name] = _patterns(value, f.name)
        else:
            out[f.name] = _strings(value, f.name)
    if "dictionaries" in out:
        out["dictionaries"] = tuple(ascii_lower(x) for x in out["dictionaries"])
    return Settings(**out)


def _quoted(x: str) -> str:
    return '"' + "".join(f"\\u{ord(c):04X}" if ord(c) < 32 or ord(c) == 127 else {"\\": "\\\\", '"': '\\"'}.get(c, c) for c in x) + '"'


def render(settings: Settings) -> str:
    """TOML without what has its default."""
    lines = []
    for f in fields(Settings)[:-1]:
        value = getattr(settings, f.name)
        if value != getattr(Settings(), f.name):
            lines.append(f"{f.name} = {('[' + ', '.join(map(_quoted, value)) + ']') if isinstance(value, tuple) else str(value).lower()}")
    for o in settings.overrides:
        lines += ["", "[[overrides]]"]
        lines += [f"{f.name} = [{', '.join(map(_quoted, getattr(o, f.name)))}]" for f in fields(Override) if getattr(o, f.name) is not None]
    return "\n".join(lines) + "\n" if lines else ""


def find_upwards(start: str | Path) -> Path | None:
    """The nearest settings file from a directory up."""
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        for name in FILE_NAMES:
            if (folder / name).is_file():
                return folder / name
    return None


def expand_home(path: str) -> str:
    """Only `~` and `~/...` mean the home directory."""
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def global_path() -> Path:
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return Path(base) / "quillspark" / FILE_NAMES[0]


class Watched:
    """A settings file that is read again when its time or size changes.

    A deleted file clears the settings; one that cannot be parsed leaves the last good ones and is
    reported once for each broken state.
    """

    def __init__(self, path: str | Path | None):
        self.path = Path(path) if path else None
        self.settings: Settings | None = None
        self.stamp: tuple[int, int] | None = None
        self.errors: list[str] = []

    def reload(self) -> bool:
        """Whether the settings changed."""
        now = None
        try:
            if self.path:
                stat = os.stat(self.path)
                now = (stat.st_mtime_ns, stat.st_size)
        except FileNotFoundError:
            pass
        if now == self.stamp:
            return False
        self.stamp = now
        if now is None:
            changed, self.settings = self.settings is not None, None
            return changed
        try:
            found = parse(self.path.read_text(encoding="utf-8"))
        except (SettingsError, UnicodeDecodeError) as e:
            self.errors.append(f"{self.path}: {e}")
            return False
        changed, self.settings = found != self.settings, found
        return changed

    def save(self, settings: Settings) -> None:
        if self.path is None:
            raise SettingsError("there is no file to save to")
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_name(f".{self.path.name}.part")
        part.write_text(render(settings), encoding="utf-8")
        os.replace(part, self.path)
        self.settings = settings
        stat = os.stat(self.path)
        self.stamp = (stat.st_mtime_ns, stat.st_size)


class Policy:
    """Global and project settings together; `snapshot` is what plans are made with."""

    def __init__(self, root: str | Path = ".", project: str | Path | None = None, everywhere: str | Path | None = None):
        self.root = Path(root).resolve()
        self.project = Watched(project or find_upwards(root) or self.root / FILE_NAMES[0])
        self.everywhere = Watched(everywhere or global_path())
        self.snapshot = Settings()
        self.reload()

    def reload(self) -> bool:
        self.project.reload()
        self.everywhere.reload()
        own, above = self.project.settings or Settings(), self.everywhere.settings or Settings()
        fresh = replace(above, use_global=own.use_global).merged(own) if own.use_global else own
        changed, self.snapshot = fresh != self.snapshot, fresh
        return changed

    def add(self, name: str, item: str, everywhere: bool = False) -> bool:
        """Add to a list of the project's (or the global) file; False if it is there already."""
        target = self.everywhere if everywhere else self.project
        settings, new = (target.settings or Settings()).with_item(name, item)
        if new:
            target.save(settings)
            self.reload()
        return new

    def for_path(self, path: str | None) -> Settings:
        return self.snapshot if path is None or not self.snapshot.overrides else self.snapshot.resolved(path)


def overrides_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """(ordinal, pattern) and the eight lists, for joining to paths."""
    rows = [(k, "|".join(f"(?:{glob_regex(g)})" for g in o.paths), *(None if getattr(o, n) is None else list(getattr(o, n)) for n in (*LISTS, *(f"extra_{x}" for x in LISTS)))) for k, o in enumerate(settings.overrides)]
    ddl = "ordinal int, pattern string, " + ", ".join(f"{n} array<string>" for n in (*LISTS, *(f"extra_{x}" for x in LISTS)))
    return spark.createDataFrame(rows, ddl)


def resolved_lists(paths: DataFrame, settings: Settings, path: str = "path") -> DataFrame:
    """Distinct paths with their four lists after all overrides, in generated code.

    Overrides are a handful of literals, so each list is a chain of CASEs over the path: nothing is
    joined and nothing is shuffled but the distinct.
    """
    df = paths.select(path).distinct()
    state = {n: F.array(*[F.lit(x) for x in getattr(settings, n)]).cast("array<string>") for n in LISTS}
    for block in settings.overrides:
        hit = path_matches(F.col(path), block.paths)
        for n in LISTS:
            own, extra = getattr(block, n), getattr(block, f"extra_{n}")
            if own is not None or extra is not None:
                base = state[n] if own is None else F.array(*[F.lit(x) for x in own]).cast("array<string>")
                state[n] = F.when(hit, F.concat(base, F.array(*[F.lit(x) for x in extra or ()]).cast("array<string>"))).otherwise(state[n])
    return df.select(path, *[c.alias(n) for n, c in state.items()])
