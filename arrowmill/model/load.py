"""Model sources: model text, model JSON and schema JSON. Each adds to a catalogue."""

from __future__ import annotations

import json
import re

from ..errors import AnalysisError, Rule
from ..language.parser import parse
from .catalog import Catalog, ClassInfo, Member, Multiplicity

_TEMPORAL = {"businesstemporal": "business", "processingtemporal": "processing", "bitemporal": "bitemporal", "business": "business", "processing": "processing"}
_PATH = r"[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*"
_ELEMENT = re.compile(rf"\b(Class|Association|Enum|Profile)\s+((?:<<[^>]*>>\s*)?)((?:\{{[^}}]*\}}\s*)?)({_PATH})\s*(?:<[^>]*>)?\s*(?:extends\s+((?:{_PATH}\s*,\s*)*{_PATH}))?\s*", re.S)
_PROPERTY = re.compile(rf"\s*(?:<<[^>]*>>\s*)?(?:\{{[^}}]*\}}\s*)?(\w+)\s*(\([^)]*\)\s*\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})?\s*:\s*({_PATH})\s*\[([^\]]*)\]\s*;", re.S)


def _temporal(stereotypes) -> str | None:
    for s in stereotypes:
        if (found := _TEMPORAL.get(s.rsplit(".", 1)[-1].strip().lower())) is not None:
            return found
    return None


def _braces(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != "{":
        raise AnalysisError(Rule.SYNTAX, "'{' expected", at)
    depth, quoted = 0, False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return text[at + 1 : i], i + 1
    raise AnalysisError(Rule.SYNTAX, "'}' expected", len(text))


def _members(body: str) -> list[Member]:
    found, at = [], 0
    while body[at:].strip():
        m = _PROPERTY.match(body, at)
        if m is None:
            raise AnalysisError(Rule.SYNTAX, f"a property is expected: {body[at:].strip()[:40]!r}", at)
        name, qualified, kind, many = m.groups()
        if qualified:
            head, _, rest = qualified.partition(")")
            names = tuple(p.split(":")[0].strip() for p in head[1:].split(",") if p.strip())
            code = rest.strip()[1:-1].strip()
            found.append(Member(name, kind, Multiplicity.of(many), parameters=names, body=parse(code) if code else None))
        else:
            found.append(Member(name, kind, Multiplicity.of(many)))
        at = m.end()
    return found


def from_text(text: str, catalog: Catalog | None = None) -> Catalog:
    """Class, Association, Enum and Profile elements."""
    catalog = catalog or Catalog()
    text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    ends, at = [], 0
    while text[at:].strip():
        if m := re.compile(r"\s*(?:import\s+[\w:*]+;|###\w+)").match(text, at):
            at = m.end()
            continue
        m = _ELEMENT.match(text, at + len(text[at:]) - len(text[at:].lstrip()))
        if m is None:
            raise AnalysisError(Rule.SYNTAX, f"an element is expected: {text[at:].strip()[:40]!r}", at)
        kind, stereotypes, _, path, supers = m.groups()
        body, at = _braces(text, m.end())
        marks = re.findall(r"[\w.:]+", stereotypes or "")
        if kind == "Class":
            catalog.add(ClassInfo(path, _members(body), tuple(s.strip() for s in (supers or "").split(",") if s.strip()), _temporal(marks)))
        elif kind == "Association":
            ends.append((path, _members(body)))
        elif kind == "Enum":
            catalog.enums[path] = tuple(v.strip() for v in body.split(",") if v.strip())
    for path, pair in ends:
        if len(pair) != 2:
            raise AnalysisError(Rule.SYNTAX, f"association {path} needs two ends")
        _associate(catalog, pair)
    return catalog


def _associate(catalog: Catalog, pair: list[Member]) -> None:
    """Each end belongs to the class at the other end."""
    for end, other in (pair, reversed(pair)):
        if catalog.knows(other.type):
            owner = catalog.find(other.type)
            owner.members.append(Member(end.name, end.type, end.multiplicity, association=True))


def _many(raw: dict | None) -> Multiplicity:
    raw = raw or {}
    return Multiplicity(raw.get("lowerBound", 0), raw.get("upperBound"))


def _type(raw) -> str:
    if isinstance(raw, str):
        return raw
    if raw and raw.get("kind"):
        return raw.get("name") or raw.get("path")
    return (raw or {}).get("fullPath") or _type((raw or {}).get("rawType"))


def from_model_json(text: str | dict, catalog: Catalog | None = None) -> Catalog:
    """Elements of kind class, association and enumeration; all others are out of scope and skipped."""
    catalog = catalog or Catalog()
    data = json.loads(text) if isinstance(text, str) else text
    pairs = []
    for e in data.get("elements", []):
        kind = str(e.get("_type", "")).lower()
        if kind not in ("class", "association", "enumeration"):
            continue
        path = f"{e['package']}::{e['name']}" if e.get("package") else e["name"]
        marks = [s.get("value", "") for s in e.get("stereotypes", [])]
        read = lambda p, **more: Member(p["name"], _type(p.get("type") or p.get("returnType") or (p.get("genericType") or p.get("returnGenericType"))), _many(p.get("multiplicity") or p.get("returnMultiplicity")), **more)
        if kind == "class":
            members = [read(p) for p in e.get("properties", [])]
            for q in e.get("qualifiedProperties", []):
                generated = any("generated" in s.get("value", "") for s in q.get("stereotypes", []))
                members.append(read(q, parameters=tuple(p.get("name", "") for p in q.get("parameters", [])), generated=generated))
            supers = tuple(_type(s) if isinstance(s, str) else s.get("path") or _type(s) for s in e.get("superTypes", []))
            catalog.add(ClassInfo(path, members, supers, _temporal(marks)))
        elif kind == "association":
            pairs.append([read(p) for p in e.get("properties", [])])
        elif kind == "enumeration":
            catalog.enums[path] = tuple(v["value"] for v in e.get("values", []))
    for pair in pairs:
        if len(pair) == 2:
            _associate(catalog, pair)
    return catalog


def from_schema_json(text: str | dict, catalog: Catalog | None = None) -> Catalog:
    """The compact schema form: db_path, classes by path, associations and enums."""
    catalog = catalog or Catalog()
    data = json.loads(text) if isinstance(text, str) else text

    def member(p: dict, **more) -> Member:
        many = p.get("multiplicity", p.get("mult"))
        if isinstance(many, dict):
            many = Multiplicity(many.get("lower", many.get("lowerBound", 0)), many.get("upper", many.get("upperBound")))
        elif isinstance(many, (list, tuple)):
            many = Multiplicity(many[0], many[1])
        else:
            many = Multiplicity.of((many or "1").strip("[]"))
        return Member(p["name"], _type(p.get("type") or p.get("target") or p.get("target_class")), many, **more)

    if data.get("db_path"):
        catalog.stores.add(data["db_path"])
    for path, c in data.get("classes", {}).items():
        members = [member(p) for p in c.get("properties", [])]
        members += [member(q, parameters=tuple(q.get("parameters", ()))) for q in c.get("qualified_properties", [])]
        catalog.add(ClassInfo(path, members, tuple(c.get("super_types", ())), _temporal([c.get("temporal") or ""])))
    for a in data.get("associations", []):
        ends = a.get("ends") or a.get("properties") or [a.get("end_a"), a.get("end_b")]
        pair = [member({"name": e.get("property_name") or e.get("property"), **e} if "name" not in e else e) for e in ends if e]
        if len(pair) == 2:
            _associate(catalog, pair)
    catalog.enums.update({k: tuple(v if isinstance(v, list) else v.get("values", ())) for k, v in data.get("enums", {}).items()})
    return catalog
