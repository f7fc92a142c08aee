"""Rules of naming: the property table, and what follows from the tables by rule.

Callers add rows of their own through ``property_rules``, or a file of them
(:func:`factloom.sources.files.read_property_rules`): the table holds the
language's own objects and no more.
"""

from __future__ import annotations

from collections.abc import Iterable

from factloom.functions import tables

# Property and score, by the type that the property speaks for.
PROPERTIES: dict[str, dict[str, int]] = {
    "array": {
        "push": 5, "pop": 5, "shift": 5, "unshift": 5, "splice": 5, "slice": 4, "join": 5, "sort": 4, "reverse": 4, "flat": 4, "flatMap": 5,
        "fill": 4, "copyWithin": 5, "findIndex": 5, "findLast": 4,
    },
    "iterable": {
        "forEach": 4, "map": 5, "filter": 5, "reduce": 5, "reduceRight": 5, "find": 4, "includes": 3, "some": 4, "every": 4, "indexOf": 3,
        "values": 3,
    },
    "sized": {"length": 3},
    "string": {
        "split": 6, "trim": 5, "trimStart": 5, "trimEnd": 5, "replace": 4, "replaceAll": 5, "match": 4, "startsWith": 6, "endsWith": 6,
        "substring": 5, "toUpperCase": 6, "toLowerCase": 6, "padStart": 6, "padEnd": 6, "repeat": 4, "charCodeAt": 6, "charAt": 5,
    },
    "promise": {"then": 7, "catch": 7, "finally": 5},
    "map": {"get": 4, "set": 4, "has": 4, "delete": 4, "entries": 4, "keys": 3, "size": 4, "clear": 4},
    "set": {"add": 5},
    "emitter": {"on": 6, "emit": 7, "off": 6, "once": 6, "removeListener": 7, "addListener": 7, "addEventListener": 6, "removeEventListener": 6},
    "function": {"call": 6, "apply": 6, "bind": 6},
    "error": {"stack": 7, "message": 6, "code": 5, "cause": 6, "name": 4},
    "stream": {"pipe": 7, "write": 5, "read": 5, "end": 4, "resume": 5, "pause": 5, "destroy": 5, "readable": 5, "writable": 5},
    "ctor": {"prototype": 7, "constructor": 4, "create": 5, "extend": 5},
    "process": {"exit": 7, "argv": 7, "env": 6, "cwd": 6, "stdout": 6, "stderr": 6, "stdin": 6, "pid": 6, "platform": 5, "nextTick": 7},
    "parser": {"parse": 6, "deserialize": 6},
    "serializer": {"stringify": 6, "serialize": 6, "toJSON": 5},
    "encoder": {"encode": 6},
    "decoder": {"decode": 6},
    "object": {"assign": 5, "freeze": 5, "fromEntries": 5, "defineProperty": 5, "hasOwnProperty": 4},
    "fs": {"readFile": 8, "writeFile": 8, "readFileSync": 8, "writeFileSync": 8, "existsSync": 7, "mkdirSync": 7, "statSync": 7, "readdirSync": 7},
    "httpResponse": {"statusCode": 7, "statusMessage": 6, "writeHead": 7},
    "httpMessage": {"setHeader": 7, "getHeader": 6, "socket": 5},
    "url": {"pathname": 7, "hostname": 7, "protocol": 7, "searchParams": 7, "href": 6, "origin": 6, "host": 6, "port": 5, "hash": 5},
    "element": {
        "querySelector": 8, "querySelectorAll": 8, "getElementById": 8, "getAttribute": 7, "setAttribute": 7, "appendChild": 7,
        "removeChild": 7, "textContent": 6, "innerHTML": 6, "classList": 6, "style": 5, "parentNode": 6, "children": 5,
    },
    "response": {"json": 7, "text": 6, "ok": 5, "status": 5, "headers": 5, "body": 5},
    "request": {"url": 5, "method": 6},
    "abortCtrl": {"signal": 7, "abort": 8, "aborted": 6},
    "hasher": {"digest": 8, "update": 6},
    "buffer": {"byteLength": 6, "byteOffset": 5, "subarray": 6, "copy": 6},
    "websocket": {"readyState": 7, "send": 6, "close": 5},
    "number": {"toFixed": 6, "toPrecision": 6},
    "logger": {"debug": 6, "info": 5, "warn": 6, "trace": 6, "log": 4},
    "iterator": {"next": 6, "return": 5, "throw": 5, "done": 5},
    "worker": {"postMessage": 7, "terminate": 7},
    "module": {"exports": 5, "require": 5},
    "ref": {"current": 5},
}

SURE_CLASSES = frozenset(tables.SURE_CLASSES)
SCHEMA_METHODS = frozenset(tables.SCHEMA_METHODS)
PLAIN_PROPERTIES = frozenset(tables.PLAIN_PROPERTIES)
PLAIN_IMPORTS = frozenset(tables.PLAIN_IMPORTS)
ERROR_CLASSES = frozenset(tables.ERROR_CLASSES)
EVENTS = frozenset((*tables.EVENTS, *tables.EVENT_HANDLERS))


def property_rules(extra: Iterable[tuple[str, str, int]] = ()) -> list[tuple[str, str, int]]:
    """(property, type, score): of several rules for one property the highest stays, the first of equal ones."""
    found: dict[str, tuple[str, int]] = {}
    own = [(prop, kind, score) for kind, scores in PROPERTIES.items() for prop, score in scores.items()]
    for prop, kind, score in [*own, *extra]:
        if prop not in found or score > found[prop][1]:
            found[prop] = (kind, score)
    return [(p, t, s) for p, (t, s) in found.items()]


def handler_name(event: str) -> str:
    """What the handler of an event is called."""
    return tables.EVENT_HANDLERS.get(event, f"{event}Handler")


def module_name(path: str) -> str | None:
    """What a known module is called that is imported as a whole."""
    return tables.MODULE_PATHS.get(path) or tables.MODULES.get(path.removeprefix("node:"))


def argument_rules() -> list[tuple[str, int, str, int]]:
    """(callee, place, type, score); place -1 stands for all places.

    A callee is a function's name, ``.method`` of any object, or ``object.method``
    where that object's method takes other arguments.
    """
    rows = [(f".{name}", -1, kind, score) for name, (kind, score) in tables.ALL_ARGUMENTS.items()]
    for mark, table in ((".", tables.METHOD_ARGUMENTS), ("", tables.OBJECT_ARGUMENTS), ("", tables.FUNCTION_ARGUMENTS)):
        for name, places in table.items():
            rows += [(mark + name, k, *told) for k, told in enumerate(places) if told]
    return rows


def shape_rules() -> list[tuple[str, str, int, int, str]]:
    """(rule, name, score, ordinal, prop): a row for each property of each shape."""
    return [(f"shape{k}", name, score, k, prop) for k, (props, name, score) in enumerate(tables.SHAPES) for prop in props]


def namespace_rules() -> list[tuple[str, str, int, int, int, str]]:
    """(rule, name, score, ordinal, required, prop): a row for each constant of each namespace."""
    return [(name, name, score, k, least, prop) for k, (name, score, least, props) in enumerate(tables.NAMESPACES) for prop in props]


def switch_type(words: list[str]) -> tuple[str, int] | None:
    """The type, and its score, of what is switched on, by the strings of the cases."""
    for vocabulary, kind, score, need in tables.SWITCH_WORDS:
        if any(w in vocabulary for w in words) if need == "any" else len(words) > 1 and all(w in vocabulary for w in words):
            return kind, score
    return None
