"""Profiles: which roles count, how unknown roles are treated, which methods apply.

Ten profiles in four families; versions of a family differ in the passive rule
alone.  A profile is plain data: it can be shown, hashed (its JSON bytes), joined as
a table of rules, or given as a document of one's own (``from_dict``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

from prosegauge import fixed
from prosegauge.errors import ProfileError

SEMVER = re.compile(r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?", re.ASCII)
PIPELINE_ID = re.compile(r"[a-z0-9]+(?:[a-z0-9._-]*[a-z0-9])?")
STATUSES = ("provisional", "approved", "retired")

#: Methods every profile must name, by slot; the passive rule has three versions.
METHODS = {
    "tokenizer": ("readability-token-stream", "0.1.0"),
    "sentence_segmenter": ("semantic-block-sentence-segmentation", "0.1.0"),
    "character_counter": ("readability-character-token", "0.1.0"),
    "syllable_counter": ("word-syllable-estimate", "0.1.0"),
    "readability_formula": ("readability-arithmetic", "0.1.0"),
}
PASSIVE_METHOD = "bounded-passive-sentence-rule"
PASSIVE_VERSIONS = {"0.3.0": 3, "0.4.0": 4, "0.5.0": 5}
SCOPES = {"document_content": fixed.METRICS[:1], "readability_sentences": fixed.METRICS[1:]}

_READ = ("body", "table", "list")
_COUNTED = ("body", "heading", "table", "list")
#: Family: pipeline, whether unknown roles count, and the versions with their passive rule.
FAMILIES = {
    "generic-pdf-estimate": ("generic-pdf-estimate-analysis", True, {"0.4.0": "0.3.0", "0.5.0": "0.4.0", "0.6.0": "0.5.0"}),
    "pdf-estimate": ("tagged-pdf-estimate-analysis", True, {"0.5.0": "0.3.0", "0.6.0": "0.4.0", "0.7.0": "0.5.0"}),
    "semantic-html": ("semantic-html-analysis", False, {"0.4.0": "0.3.0", "0.5.0": "0.4.0", "0.6.0": "0.5.0"}),
    "word-html": ("word-derived-html-analysis", False, {"0.1.0": "0.5.0"}),
}


@dataclass(frozen=True)
class Rule:
    include: tuple[str, ...]
    exclude: tuple[str, ...]
    unknown_policy: str

    def __post_init__(self):
        named = [*self.include, *self.exclude]
        if sorted(named) != sorted(fixed.ROLES):
            raise ValueError("include and exclude must name every role once: " + ", ".join(sorted(set(named) ^ set(fixed.ROLES)) or named))
        if self.unknown_policy not in fixed.UNKNOWN_POLICIES:
            raise ValueError(f"unsupported unknown_role_policy: {self.unknown_policy}")
        if (self.unknown_policy == "warn_and_include") != ("unknown" in self.include):
            raise ValueError(f"{self.unknown_policy} contradicts where unknown is listed")

    def to_dict(self) -> dict:
        return {"include_roles": list(self.include), "exclude_roles": list(self.exclude), "unknown_role_policy": self.unknown_policy}


@dataclass(frozen=True)
class Method:
    """A configured method, or the reason why there is none."""

    id: str | None = None
    version: str | None = None
    reason: str | None = None

    def __post_init__(self):
        if bool(self.id and self.id.strip() and self.version and self.version.strip()) == bool(self.reason):
            raise ValueError("a method has an id and a version, or else a reason")

    @property
    def reference(self) -> str:
        return f"{self.id}@{self.version}" if self.id else "unavailable"

    def to_dict(self) -> dict:
        if self.reason:
            return {"status": "unavailable", "reason": self.reason}
        return {"status": "configured", "id": self.id, "version": self.version}


@dataclass(frozen=True)
class Profile:
    id: str
    version: str
    status: str
    description: str
    rules: Mapping[str, Rule]
    methods: Mapping[str, Method]
    pipeline: tuple[str, str] | None
    schema_version: str = "1.1.0"

    def __post_init__(self):
        for name in ("id", "version", "description"):
            if not str(getattr(self, name) or "").strip():
                raise ValueError(f"profile {name} must be a non-empty string")
        if self.status not in STATUSES:
            raise ValueError(f"unsupported profile status: {self.status}")
        if self.schema_version not in ("1.0.0", "1.1.0") or (self.schema_version == "1.1.0") != (self.pipeline is not None):
            raise ValueError("profile schema 1.1.0 declares a pipeline, 1.0.0 none")
        if self.pipeline and not (PIPELINE_ID.fullmatch(self.pipeline[0]) and SEMVER.fullmatch(self.pipeline[1])):
            raise ValueError("pipeline id or version is malformed")
        if set(self.rules) != set(fixed.METRICS):
            raise ValueError("a profile has a rule for each metric and for nothing else")
        if set(self.methods) != set(fixed.METHOD_SLOTS):
            raise ValueError("a profile has a method for each slot and for nothing else")

    @property
    def reference(self) -> str:
        return f"{self.id}@{self.version}"

    @property
    def passive_version(self) -> int:
        """Version of the passive rule; a profile with another method is refused."""
        for slot, wanted in METHODS.items():
            if self.methods[slot].reference != "@".join(wanted):
                raise ProfileError(f"{slot} must be {'@'.join(wanted)!r}; profile declares {self.methods[slot].reference!r}")
        method = self.methods["passive_classifier"]
        if method.id != PASSIVE_METHOD or method.version not in PASSIVE_VERSIONS:
            raise ProfileError(f"no such passive_classifier method: {method.reference!r}")
        return PASSIVE_VERSIONS[method.version]

    def scope_rule(self, scope: str) -> Rule:
        """The one rule that all metrics of a scope share."""
        found = {self.rules[m] for m in SCOPES[scope]}
        if len(found) != 1:
            raise ProfileError(f"metrics of {scope} must share one selection rule")
        return found.pop()

    def to_dict(self) -> dict:
        out = {
            "schema_version": self.schema_version,
            "profile_id": self.id,
            "profile_version": self.version,
            "status": self.status,
            "description": self.description,
        }
        if self.pipeline:
            out["pipeline"] = {"id": self.pipeline[0], "version": self.pipeline[1]}
        out["metrics"] = {m: self.rules[m].to_dict() for m in fixed.METRICS}
        out["methods"] = {s: self.methods[s].to_dict() for s in fixed.METHOD_SLOTS}
        return out

    @classmethod
    def from_dict(cls, value: Mapping) -> Profile:
        pipeline = value.get("pipeline")
        return cls(
            value["profile_id"],
            value["profile_version"],
            value["status"],
            value["description"],
            {m: Rule(tuple(r["include_roles"]), tuple(r["exclude_roles"]), r["unknown_role_policy"]) for m, r in value["metrics"].items()},
            {s: Method(m.get("id"), m.get("version"), m.get("reason")) for s, m in value["methods"].items()},
            (pipeline["id"], pipeline["version"]) if pipeline else None,
            value["schema_version"],
        )

    @property
    def document(self) -> bytes:
        return (json.dumps(self.to_dict(), indent=2) + "\n").encode()

    @property
    def sha256(self) -> str:
        return sha256(self.document).hexdigest()


def _rule(included: tuple[str, ...], unknown_counts: bool) -> Rule:
    include = tuple(r for r in fixed.ROLES if r in included or (unknown_counts and r == "unknown"))
    return Rule(include, tuple(r for r in fixed.ROLES if r not in include), "warn_and_include" if unknown_counts else "unable_to_calculate")


@cache
def all_profiles() -> dict[str, Profile]:
    """Packaged profiles by reference, in order."""
    out = {}
    for family, (pipeline, unknown_counts, versions) in FAMILIES.items():
        for version, passive in versions.items():
            rules = {m: _rule(_COUNTED if m == "word_count" else _READ, unknown_counts) for m in fixed.METRICS}
            methods = {s: Method(*m) for s, m in METHODS.items()} | {"passive_classifier": Method(PASSIVE_METHOD, passive)}
            text = f"Provisional {family} profile; passive sentences by version {passive} of the bounded rule."
            profile = Profile(family, version, "provisional", text, rules, methods, (pipeline, "0.1.0"))
            out[profile.reference] = profile
    return dict(sorted(out.items()))


def load_profile(reference: str) -> Profile:
    try:
        return all_profiles()[reference]
    except KeyError:
        raise ProfileError(f"Unknown profile: {reference}") from None


def list_profiles() -> list[str]:
    return list(all_profiles())
