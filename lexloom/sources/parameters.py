"""XML parameter files."""

from __future__ import annotations

from pathlib import Path
from xml.etree import ElementTree

from ..errors import BadFormatError

Parameters = str | list | dict


def load(path: str | Path) -> Parameters:
    return parse(Path(path).read_text())


def parse(source: str) -> Parameters:
    """Text, a list (children of one tag) or a dict (children of different tags)."""
    try:
        root = ElementTree.fromstring(source)
    except ElementTree.ParseError as e:
        raise BadFormatError(f"not XML: {e}") from e
    if root.tag != "parameters":
        raise BadFormatError(f"<parameters> expected, not <{root.tag}>")
    return _value(root)


def _value(node: ElementTree.Element) -> Parameters:
    children = list(node)
    if not children:
        return (node.text or "").strip()
    tags = [c.tag for c in children]
    if len(set(tags)) == 1:
        return [_value(c) for c in children]
    if len(set(tags)) < len(tags):
        raise BadFormatError(f"<{node.tag}> mixes repeated and single tags")
    return {c.tag: _value(c) for c in children}


def get(parameters: Parameters, *path: str) -> Parameters | None:
    """The value at a path of keys; a list of one is what it holds."""
    for key in path:
        if isinstance(parameters, list) and len(parameters) == 1:
            parameters = parameters[0]
        if not isinstance(parameters, dict) or key not in parameters:
            return None
        parameters = parameters[key]
    return parameters
