"""robots.txt: groups of rules, line by line."""

from __future__ import annotations

import re
from typing import Any

from webloom.kernel.text import number_prefix, trim, utf16_len


def parse_robots(text: str) -> dict[str, list]:
    """groups (agents, rules of allow and path, crawl_delay) and sitemaps, in the order of the file.

    A blank line ends a group. Rules before any user-agent belong to a group for all.
    """
    groups: list[dict[str, Any]] = []
    sitemaps: list[str] = []
    group: dict[str, Any] | None = None
    naming = False  # the group still gathers agents
    for line in re.split(r"\r?\n", text):
        if not trim(line):
            group, naming = None, False
            continue
        line = trim(line.partition("#")[0])
        field, colon, value = line.partition(":")
        if not colon:
            continue
        field, value = trim(field).lower(), trim(value)
        if field == "sitemap":
            sitemaps += [value] if value else []
            continue
        if field == "user-agent":
            if group is None or not naming:
                group, naming = {"agents": [], "rules": [], "crawl_delay": None}, True
                groups.append(group)
            group["agents"].append(value.lower())
            continue
        if group is None:
            group = {"agents": ["*"], "rules": [], "crawl_delay": None}
            groups.append(group)
        naming = False
        if field == "disallow" or field == "allow" and value:
            group["rules"].append({"allow": field == "allow", "path": value})
        elif field == "crawl-delay" and (delay := number_prefix(value)) is not None:
            group["crawl_delay"] = delay
    return {"groups": groups, "sitemaps": sitemaps}


# Verdicts

#: What ``*`` doesn't stand for.
_LINE_ENDS = frozenset("\n\r\u2028\u2029")
Rank = tuple[int, bool, int]
Pattern = tuple[str, bool, Rank]


class _State:
    """What may follow the same beginning of some patterns, and the best rule that ends here, anywhere or at a path's end.

    A remainder that a single pattern has is kept as text (``rest``) and matched at once.
    """

    __slots__ = ("at_end", "end", "letters", "rest", "run")

    def __init__(self) -> None:
        self.letters: dict[str, _State] = {}
        self.run: _State | None = None
        self.rest: Pattern | None = None
        self.end: Rank | None = None
        self.at_end: Rank | None = None


def _compiled(patterns: list[Pattern]) -> _State:
    root = _State()
    waiting = [(root, patterns, 0)]
    while waiting:
        state, group, at = waiting.pop()
        if len(group) == 1 and at < len(group[0][0]) and "*" not in group[0][0][at:]:
            text, anchored, rank = group[0]
            state.rest = text[at:], anchored, rank
            continue
        following: dict[str, list[Pattern]] = {}
        for pattern in group:
            text, anchored, rank = pattern
            if at < len(text):
                following.setdefault(text[at], []).append(pattern)
            elif anchored:
                state.at_end = max(state.at_end or rank, rank)
            else:
                state.end = max(state.end or rank, rank)
        for letter, those in following.items():
            after = _State()
            if letter == "*":
                state.run = after
            else:
                state.letters[letter] = after
            waiting.append((after, those, at + 1))
    return root


class RuleTrie:
    """The rules of a group as one trie with states for wildcards: a path is walked once, however many rules there are.

    A rule matches a path that begins with it; ``*`` is any run, a final ``$`` the end. The longest matching rule counts, an
    allowing one before others of its length, else the first.
    """

    def __init__(self, rules: list[dict[str, Any]]) -> None:
        self.rules = rules
        patterns = []
        for i, rule in enumerate(rules):
            if path := rule["path"]:
                anchored = path.endswith("$")
                patterns.append((re.sub(r"\*+", "*", path.removesuffix("$") if anchored else path), anchored, (utf16_len(path), bool(rule["allow"]), -i)))
        self.root = _compiled(patterns)

    def best(self, path: str) -> dict[str, Any] | None:
        found: Rank = (-1, False, 0)
        fresh, runs = [self.root], {}  # states just reached, and those that a run may still reach
        for at in range(len(path) + 1):
            last = at == len(path)
            for s in fresh:
                if s.run is not None:
                    runs[id(s.run)] = s.run
            for s in (*fresh, *runs.values()):
                if s.end is not None and s.end > found:
                    found = s.end
                if last and s.at_end is not None and s.at_end > found:
                    found = s.at_end
                if s.rest is not None and s.rest[2] > found and path.startswith(s.rest[0], at) and (not s.rest[1] or at + len(s.rest[0]) == len(path)):
                    found = s.rest[2]
            if last or not (fresh or runs):
                break
            letter = path[at]
            fresh = [n for s in (*fresh, *runs.values()) if (n := s.letters.get(letter)) is not None]
            if letter in _LINE_ENDS:
                runs = {}
        return self.rules[-found[2]] if found[0] >= 0 else None


class RobotsFile:
    """The groups of a file, ready for any agents and paths: tokens are found by one automaton, groups' rules compiled when they are first needed."""

    def __init__(self, groups: list[dict[str, Any]] | None) -> None:
        self.groups = groups or []
        first: dict[str, int] = {}
        for i, group in enumerate(self.groups):
            for token in group["agents"] or []:
                first.setdefault(token, i)
        self.everyone = first.pop("*", None)
        first.pop("", None)
        self.tokens = _Tokens(first)
        self.chosen: dict[str, int | None] = {}
        self.tries: dict[int, RuleTrie] = {}

    def group_of(self, agent: str) -> int | None:
        """The group with the longest token that the agent contains, of equal ones the first; else the first for all."""
        if agent not in self.chosen:
            if len(self.chosen) > 10_000:
                self.chosen.clear()
            named = self.tokens.longest(agent.lower())
            self.chosen[agent] = self.everyone if named is None else named
        return self.chosen[agent]

    def verdict(self, agent: str, path: str) -> dict[str, Any]:
        """allow and path of the rule that counts (None: none does), crawl_delay."""
        i = self.group_of(agent)
        if i is None:
            return {"allow": None, "path": None, "crawl_delay": None}
        if i not in self.tries:
            self.tries[i] = RuleTrie(self.groups[i]["rules"] or [])
        rule = self.tries[i].best(path) or {"allow": None, "path": None}
        return {"allow": rule["allow"], "path": rule["path"], "crawl_delay": self.groups[i]["crawl_delay"]}


class _Tokens:
    """Aho-Corasick automaton over tokens with the group that each names first."""

    def __init__(self, group: dict[str, int]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.back, self.best = [0], [None]
        for token, i in group.items():
            at = 0
            for letter in token:
                if letter not in self.next[at]:
                    self.next[at][letter] = len(self.next)
                    self.next.append({})
                    self.back.append(0)
                    self.best.append(None)
                at = self.next[at][letter]
            self.best[at] = (utf16_len(token), -i)
        queue = list(self.next[0].values())
        for at in queue:  # by depth: the list grows while it is read
            behind = self.best[self.back[at]]
            if behind is not None and (self.best[at] is None or behind > self.best[at]):
                self.best[at] = behind
            for letter, to in self.next[at].items():
                back = self.back[at]
                while back and letter not in self.next[back]:
                    back = self.back[back]
                self.back[to] = self.next[back].get(letter, 0)
                queue.append(to)

    def longest(self, agent: str) -> int | None:
        at, found = 0, None
        for letter in agent:
            while at and letter not in self.next[at]:
                at = self.back[at]
            at = self.next[at].get(letter, 0)
            if self.best[at] is not None and (found is None or self.best[at] > found):
                found = self.best[at]
        return None if found is None else -found[1]
