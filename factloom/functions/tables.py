"""Fixed values of naming: tables that decide results and have no rule behind them.

Everything here is data, stated as it is.  What follows from a rule (a type
that is shown by its own name, an event ``x`` whose handler is ``xHandler``,
a module with ``node:`` before its name) is left to :mod:`factloom.functions.rules`.
"""

# How a type is shown, where not by its own name.
DISPLAY = {
    "array": "arr",
    "iterable": "list",
    "sized": "items",
    "string": "str",
    "map": "registry",
    "set": "pool",
    "function": "fn",
    "error": "err",
    "ctor": "Ctor",
    "process": "proc",
    "number": "num",
    "object": "obj",
    "fs": "fsUtil",
    "httpResponse": "httpResp",
    "httpMessage": "httpMsg",
    "element": "el",
    "response": "resp",
    "request": "req",
    "buffer": "buf",
    "websocket": "ws",
    "identified": "id",
    "valued": "val",
    "positioned": "pos",
    "sourced": "src",
    "targeted": "target",
    "config": "cfg",
    "context": "ctx",
    "path": "filePath",
    "extension": "ext",
    "timeout": "timer",
    "interval": "intervalTimer",
    "module": "mod",
    "hooks": "hook",
    "iterator": "iter",
    "generator": "gen",
    "boolean": "flag",
    "optional": "opt",
    "abortSignal": "signal",
    "errClass": "ErrClass",
    "subClass": "SubClass",
    "classDef": "ClassDef",
    "namedSym": "sym",
    "symbol": "sym",
    "bigint": "bigNum",
    "pathSegment": "pathSeg",
    "displayable": "displayVal",
    "timerFn": "timerCallback",
    "milliseconds": "delayMs",
    "intervalFn": "intervalCallback",
    "resolvedValue": "resolvedVal",
    "rejectionError": "rejectionErr",
    "promiseArr": "promises",
    "thisContext": "thisCtx",
    "hashAlgo": "hashAlgorithm",
    "radix": "parseRadix",
    "errorMessage": "errMsg",
    "maybeArray": "maybeArr",
    "eventType": "eventName",
    "statusStr": "statusValue",
}

# Class of an instanceof test, and its type.
INSTANCE_TYPES = {
    "Error": "error", "TypeError": "error", "RangeError": "error", "SyntaxError": "error",
    "ReferenceError": "error", "URIError": "error", "EvalError": "error", "AggregateError": "error",
    "Promise": "promise", "RegExp": "regex", "Date": "date", "URL": "url", "URLSearchParams": "urlParams",
    "Map": "map", "Set": "set", "WeakMap": "weakMap", "WeakSet": "weakSet",
    "ArrayBuffer": "buffer", "SharedArrayBuffer": "buffer",
    "Uint8Array": "bytes", "Int8Array": "bytes", "Uint16Array": "bytes", "Int16Array": "bytes", "Uint32Array": "bytes",
    "Int32Array": "bytes", "Float32Array": "bytes", "Float64Array": "bytes", "BigInt64Array": "bytes",
    "Buffer": "buf", "Blob": "blob", "File": "file",
    "ReadableStream": "readStream", "WritableStream": "writeStream", "TransformStream": "transformStream",
    "EventEmitter": "emitter", "AbortController": "abortCtrl", "AbortSignal": "abortSignal",
    "Worker": "worker", "MessageChannel": "channel", "MessagePort": "port",
    "WebSocket": "websocket", "XMLHttpRequest": "xhr",
    "FormData": "formData", "Headers": "headers", "Request": "req", "Response": "resp",
    "MutationObserver": "observer", "ResizeObserver": "observer",
    "IntersectionObserver": "observer", "PerformanceObserver": "observer",
}

# Answer of typeof, and its type.
TYPEOF_TYPES = {
    "function": "function", "string": "string", "number": "number", "boolean": "boolean",
    "symbol": "symbol", "object": "object", "undefined": "optional", "bigint": "bigint",
}

# Events whose handlers are named after them, with the ending "Handler".
EVENTS = (
    "error", "close", "data", "end", "drain", "message", "connect", "disconnect", "open", "ready", "finish", "abort", "timeout",
    "request", "response", "upgrade", "connection", "pause", "resume", "change", "progress", "load", "unload", "click", "submit",
    "input", "focus", "blur", "scroll", "resize", "popstate", "install", "activate", "fetch", "push", "sync", "exit", "warning",
    "update", "delete", "insert", "select", "create", "destroy", "start", "stop", "reset", "clear",
)

# Events whose handlers have other names.
EVENT_HANDLERS = {
    "success": "successCallback",
    "listening": "listenHandler",
    "keydown": "keyHandler",
    "keyup": "keyHandler",
    "keypress": "keyHandler",
    "mousemove": "mouseMoveHandler",
    "mousedown": "mouseHandler",
    "mouseup": "mouseHandler",
    "mouseenter": "mouseHandler",
    "mouseleave": "mouseHandler",
    "touchstart": "touchHandler",
    "touchend": "touchHandler",
    "beforeunload": "beforeUnloadHandler",
    "hashchange": "hashChangeHandler",
    "DOMContentLoaded": "domReadyHandler",
    "notificationclick": "notifClickHandler",
    "SIGINT": "sigintHandler",
    "SIGTERM": "sigtermHandler",
    "uncaughtException": "uncaughtHandler",
    "unhandledRejection": "rejectionHandler",
}

# Constructors whose instances are surely named after them.
SURE_CLASSES = (
    "Map", "Set", "WeakMap", "WeakSet", "Promise", "Error", "TypeError", "RangeError", "Date", "URL", "URLSearchParams",
    "RegExp", "EventEmitter", "Buffer", "AbortController", "Worker", "SharedArrayBuffer",
)

# Known calls of a global, their result's name and score.
GLOBAL_CALLS = {
    "Promise": ("promise", 9),
    "setTimeout": ("timer", 7),
    "setInterval": ("intervalTimer", 7),
    "clearTimeout": ("timerRef", 5),
    "clearInterval": ("intervalRef", 5),
    "fetch": ("fetchResult", 8),
    "setImmediate": ("immediateHandle", 6),
    "queueMicrotask": ("microtask", 6),
}

# Known calls of an object's method and their result's name; they score 8.
MEMBER_CALLS = {
    "Object.create": "proto", "Object.assign": "merged", "Object.freeze": "frozen", "Object.keys": "keys",
    "Object.values": "values", "Object.entries": "entries", "Object.fromEntries": "fromEntries",
    "Array.from": "items", "Array.isArray": "isArray", "Array.of": "items",
    "Math.random": "randomVal", "Math.floor": "floored", "Math.ceil": "ceiled", "Math.round": "rounded",
    "Math.trunc": "truncated", "Math.sign": "sign", "Math.max": "maxVal", "Math.min": "minVal", "Math.abs": "absVal",
    "Math.sqrt": "sqrtVal", "Math.pow": "powVal", "Math.log": "logVal",
    "Date.now": "timestamp", "Date.parse": "parsedDate", "JSON.parse": "parsed", "JSON.stringify": "serialized",
    "Promise.all": "allPromises", "Promise.race": "racePromise", "Promise.resolve": "resolved", "Promise.reject": "rejected",
    "Promise.allSettled": "settledPromises", "Promise.any": "anyPromise",
    "Buffer.from": "buf", "Buffer.alloc": "buf", "Buffer.concat": "buf", "Buffer.isBuffer": "isBuf",
    "crypto.randomUUID": "uuid", "crypto.createHash": "hasher", "crypto.createHmac": "hmac", "crypto.randomBytes": "randomBytes",
    "path.join": "joinedPath", "path.resolve": "resolvedPath", "path.relative": "relativePath", "path.normalize": "normalizedPath",
    "path.basename": "baseName", "path.dirname": "dirName", "path.extname": "extName", "path.parse": "parsedPath", "path.format": "formattedPath",
    "fs.createReadStream": "readStream", "fs.createWriteStream": "writeStream", "fs.readFileSync": "fileContent", "fs.writeFileSync": "void",
    "fs.readdirSync": "dirEntries", "fs.statSync": "fileStat", "fs.existsSync": "exists", "fs.mkdirSync": "void",
    "url.parse": "parsedUrl", "url.format": "formattedUrl", "url.resolve": "resolvedUrl",
    "querystring.stringify": "qsStr", "querystring.parse": "qsParsed", "process.nextTick": "nextTickFn", "process.hrtime": "hrtime",
    "EventEmitter.call": "emitter", "String.fromCharCode": "str", "String.fromCodePoint": "str",
    "Number.parseInt": "num", "Number.parseFloat": "num", "Number.isInteger": "isInt", "Number.isFinite": "isFinite",
    "Number.isNaN": "isNaN", "Number.isSafeInteger": "isSafeInt",
    "Reflect.apply": "applyResult", "Reflect.construct": "obj", "Reflect.ownKeys": "keys", "Reflect.get": "val",
}

# Method, its result's name and score.
METHOD_RESULTS = {
    "bind": ("boundFn", 6),
    "call": ("callResult", 5),
    "apply": ("applyResult", 5),
    "map": ("mapped", 5),
    "flatMap": ("flatMapped", 5),
    "filter": ("filtered", 5),
    "reduce": ("reduced", 5),
    "reduceRight": ("reduced", 5),
    "find": ("found", 5),
    "findIndex": ("foundIdx", 5),
    "indexOf": ("idx", 4),
    "lastIndexOf": ("idx", 4),
    "slice": ("sliced", 4),
    "splice": ("removed", 4),
    "concat": ("combined", 4),
    "flat": ("flattened", 5),
    "split": ("parts", 5),
    "join": ("joined", 5),
    "replace": ("replaced", 5),
    "replaceAll": ("replaced", 5),
    "match": ("matched", 5),
    "matchAll": ("matches", 5),
    "search": ("searchIdx", 5),
    "trim": ("trimmed", 5),
    "trimStart": ("trimmed", 5),
    "trimEnd": ("trimmed", 5),
    "padStart": ("padded", 4),
    "padEnd": ("padded", 4),
    "repeat": ("repeated", 4),
    "sort": ("sorted", 4),
    "reverse": ("reversed", 4),
    "entries": ("entries", 5),
    "keys": ("keys", 5),
    "values": ("values", 5),
    "toString": ("str", 4),
    "valueOf": ("val", 4),
    "then": ("promise", 6),
    "catch": ("promise", 5),
    "finally": ("promise", 5),
    "toJSON": ("json", 4),
    "toISOString": ("isoStr", 6),
    "toLocaleDateString": ("dateStr", 5),
    "toFixed": ("fixedStr", 5),
    "toUpperCase": ("upper", 5),
    "toLowerCase": ("lower", 5),
    "charAt": ("char", 5),
    "charCodeAt": ("charCode", 5),
    "substring": ("substr", 4),
    "test": ("matches", 5),
    "exec": ("regexMatch", 5),
    "cloneNode": ("cloned", 6),
    "querySelector": ("el", 7),
    "querySelectorAll": ("els", 7),
    "getElementById": ("el", 7),
    "createElement": ("el", 7),
    "createTextNode": ("textNode", 7),
}

# Builders of schemas.
SCHEMA_METHODS = (
    "object", "extend", "union", "intersection", "discriminatedUnion", "array", "tuple", "string", "number", "boolean", "bigint",
    "symbol", "undefined", "null", "void", "any", "unknown", "never", "optional", "nullable", "required", "partial", "passthrough",
    "strict", "strip", "catch", "describe", "brand", "refine", "superRefine", "transform", "pipe", "and", "or", "pick", "omit",
    "merge", "deepPartial", "readonly", "promise", "function", "lazy", "set", "map", "record", "with", "schema", "validate", "shape",
)

# Properties that say nothing about a name.
PLAIN_PROPERTIES = (
    "then", "catch", "finally", "next", "done", "value", "return", "throw", "data", "body", "result", "error", "items", "list",
    "map", "set", "get", "has", "add", "delete", "clear", "size", "length", "keys", "values", "entries", "call", "apply", "bind",
    "toString", "valueOf", "toJSON", "assign", "create", "from", "of", "all", "race", "resolve", "reject", "any",
)

# Keys, methods and properties that say nothing about a lazy module or its class.
MODULE_KEYS = (
    "exports", "default", "index", "module", "string", "buffer", "object", "number", "length", "value", "values", "entries", "keys",
    "items", "list", "array", "result", "middle", "state", "props", "config", "options", "context", "version", "source", "target",
    "parent", "child", "current", "last", "first", "next", "prev", "self",
)
PLAIN_METHODS = (
    "constructor", "toString", "valueOf", "render", "init", "setup", "update", "reset", "clear", "create", "destroy", "dispose",
    "start", "stop", "run", "execute", "process", "handle",
)

# Properties whose value is not named after them.
PLAIN_VALUES = (
    "length", "prototype", "constructor", "toString", "valueOf", "default", "exports", "arguments", "caller", "name", "bind", "call",
    "apply", "then", "catch", "finally", "next", "return", "throw", "done", "value", "get", "set", "has", "add", "delete", "clear",
    "size", "keys", "values", "entries", "push", "pop", "shift", "unshift", "splice", "slice", "join", "map", "filter", "reduce",
    "includes", "indexOf", "find", "findIndex", "some", "every", "flat", "flatMap", "sort",
)

# Keys of a pattern that say nothing about the name behind them.
PLAIN_KEYS = (
    "key", "val", "data", "type", "name", "node", "next", "prev", "self", "this", "base", "init", "temp", "item", "list", "args",
    "opts", "prop", "attr", "spec", "info", "meta", "elem", "root", "head", "tail", "body", "text", "code", "size", "flag", "mode",
    "kind", "path", "file", "part", "rest", "all", "any", "max", "min", "set", "get", "add", "has", "map",
)

# Members that many enumerations have.
PLAIN_MEMBERS = (
    "None", "All", "Default", "Unknown", "Error", "Warning", "Info", "Debug", "Success", "Failure", "Start", "End", "Begin", "Finish",
    "On", "Off", "Yes", "No", "True", "False", "OK",
)

# Arrays of numbers that serve as tables.
NUMBER_ARRAYS = (
    "Uint8Array", "Uint16Array", "Uint32Array", "Int8Array", "Int16Array", "Int32Array", "Float32Array", "Float64Array",
    "BigUint64Array", "BigInt64Array",
)

# Modules that very many others load.
COMMON_MODULES = ("buffer", "util", "events", "stream", "string_decoder")

# Imported names that say nothing about a name.
PLAIN_IMPORTS = ("default", "export", "exports", "module", "value", "type", "name", "node", "data", "key", "meta", "spec")

# What a name is called that is set to such a property; they score 5.
MEMBER_NAMES = {
    "inherits": "inheritsFn", "extname": "extName", "parse": "parseFn", "stringify": "stringifyFn", "format": "formatFn",
    "resolve": "resolveFn", "join": "joinFn", "basename": "baseNameFn", "dirname": "dirNameFn", "relative": "relativePathFn",
    "normalize": "normalizeFn", "isAbsolute": "isAbsoluteFn", "createServer": "createServerFn", "connect": "connectFn",
    "createConnection": "createConnectionFn", "createHash": "createHashFn", "createHmac": "createHmacFn",
    "randomBytes": "randomBytesFn", "randomUUID": "randomUUIDFn", "readFile": "readFileFn", "writeFile": "writeFileFn",
    "readFileSync": "readFileSyncFn", "writeFileSync": "writeFileSyncFn", "existsSync": "existsSyncFn", "mkdirSync": "mkdirSyncFn",
    "stat": "statFn", "statSync": "statSyncFn", "readdir": "readdirFn", "readdirSync": "readdirSyncFn", "fetch": "fetchFn",
    "send": "sendFn", "emit": "emitFn", "on": "onFn", "once": "onceFn", "off": "offFn", "hasOwnProperty": "hasPropFn",
    "getOwnPropertyNames": "ownKeysFn", "getOwnPropertyDescriptor": "descriptorFn", "defineProperty": "definePropFn",
    "assign": "assignFn", "isApiWritable": "isApiWritableFn", "default": "defaultExport",
    "length": "count", "size": "size", "name": "name", "type": "typeStr", "status": "status", "statusCode": "statusCode",
    "message": "msg", "stack": "stackTrace", "code": "code", "url": "url", "path": "path", "href": "urlHref",
    "hostname": "hostname", "port": "port", "protocol": "protocol", "pathname": "pathname", "host": "host", "origin": "origin",
    "method": "httpMethod", "headers": "headers", "body": "body", "signal": "signal", "timeout": "timeout", "id": "id",
    "key": "key", "version": "version", "buffer": "buf", "encoding": "encoding", "socket": "socket", "server": "server",
    "client": "client", "request": "req", "response": "res", "stream": "stream", "handler": "handler", "callback": "cb",
    "options": "opts", "config": "config", "params": "params", "query": "query", "args": "args", "listeners": "listeners",
    "controller": "controller", "readable": "readable", "writable": "writable", "error": "err", "result": "result",
    "value": "val", "data": "data", "output": "output", "input": "input", "target": "target", "source": "source",
    "context": "ctx", "scope": "scope", "env": "env", "debug": "debugFn", "warn": "warnFn", "info": "infoFn", "log": "logFn",
    "prototype": "proto", "constructor": "ctor",
}

# Globals that a name may stand for, and what it is then called; they score 7.
GLOBAL_ALIASES = {
    "parseInt": "parseIntFn", "parseFloat": "parseFloatFn", "isNaN": "isNaNFn", "isFinite": "isFiniteFn",
    "encodeURIComponent": "encodeURIFn", "decodeURIComponent": "decodeURIFn", "encodeURI": "encodeURIFn", "decodeURI": "decodeURIFn",
    "clearTimeout": "clearTimeoutFn", "clearInterval": "clearIntervalFn", "setTimeout": "setTimeoutFn", "setInterval": "setIntervalFn",
    "setImmediate": "setImmediateFn", "clearImmediate": "clearImmediateFn", "queueMicrotask": "queueMicrotaskFn",
    "Function": "functionRef", "Object": "objectRef", "Array": "arrayRef", "String": "stringRef", "Number": "numberRef",
    "Boolean": "booleanRef", "Symbol": "symbolRef", "BigInt": "bigIntRef", "Proxy": "proxyRef", "Reflect": "reflectRef",
    "Promise": "promiseRef", "WeakRef": "weakRef", "globalThis": "globalRef", "global": "globalRef", "process": "processRef",
    "console": "consoleRef", "undefined": "undefinedVal",
}

# Method of a class and the role that it gives the class; classes of errors.
CLASS_ROLES = {
    "connect": "Connector", "parse": "Parser", "serialize": "Serializer", "validate": "Validator", "transform": "Transformer",
    "compile": "Compiler", "encode": "Encoder", "decode": "Decoder", "encrypt": "Cipher", "decrypt": "Cipher", "hash": "Hasher",
    "sign": "Signer", "verify": "Verifier", "handle": "Handler", "dispatch": "Dispatcher", "route": "Router", "render": "Renderer",
    "schedule": "Scheduler", "migrate": "Migrator", "listen": "Listener", "publish": "Publisher", "subscribe": "Subscriber",
    "stream": "Streamer", "pipeline": "Pipeline", "authenticate": "AuthProvider", "authorize": "Authorizer", "resolve": "Resolver",
    "reject": "Rejector", "retry": "Retrier", "throttle": "Throttler", "cache": "Cache", "index": "Indexer",
}
ERROR_CLASSES = ("Error", "TypeError", "RangeError", "SyntaxError", "ReferenceError", "URIError", "EvalError", "AggregateError")

# What an imported module is called; the same with "node:" before its name.
MODULES = {
    "path": "pathModule", "fs": "fsModule", "os": "osModule", "net": "netModule", "http": "httpModule", "https": "httpsModule",
    "http2": "http2Module", "stream": "streamModule", "crypto": "cryptoModule", "zlib": "zlibModule", "url": "urlModule",
    "dns": "dnsModule", "tls": "tlsModule", "child_process": "childProcess", "readline": "readlineModule", "events": "eventsModule",
    "util": "utilModule", "assert": "assertModule", "buffer": "bufferModule", "process": "processModule", "cluster": "clusterModule",
    "worker_threads": "workerThreads", "vm": "vmModule", "module": "moduleUtil", "perf_hooks": "perfHooks", "inspector": "inspectorMod",
    "sqlite": "sqliteModule", "v8": "v8Module",
}
# Modules that are known by one name only.
MODULE_PATHS = {"path/posix": "pathPosix", "node:fs/promises": "fsPromises"}

# Method and the types of its arguments by place, with scores.
METHOD_ARGUMENTS = {
    "readFile": (("filePath", 9), ("encoding", 7), ("callback", 7)),
    "writeFile": (("filePath", 9), ("data", 7), ("callback", 7)),
    "readFileSync": (("filePath", 9), ("encoding", 7)),
    "writeFileSync": (("filePath", 9), ("data", 7)),
    "appendFile": (("filePath", 8), ("data", 7), ("callback", 7)),
    "unlink": (("filePath", 8), ("callback", 7)),
    "stat": (("filePath", 8), ("callback", 7)),
    "mkdir": (("filePath", 8), ("callback", 7)),
    "readdir": (("filePath", 8), ("callback", 7)),
    "dirname": (("filePath", 9),),
    "basename": (("filePath", 9),),
    "extname": (("filePath", 9),),
    "relative": (("filePath", 8), ("filePath", 8)),
    "parse": (("jsonStr", 8),),
    "stringify": (("serializable", 7),),
    "setTimeout": (("timerFn", 8), ("milliseconds", 8)),
    "setInterval": (("intervalFn", 8), ("milliseconds", 8)),
    "clearTimeout": (("timerId", 8),),
    "clearInterval": (("intervalId", 8),),
    "all": (("promiseArr", 8),),
    "allSettled": (("promiseArr", 7),),
    "keys": (("object", 7),),
    "values": (("object", 7),),
    "entries": (("object", 7),),
    "assign": (("target", 7), ("source", 7)),
    "freeze": (("object", 7),),
    "create": (("protoObj", 7),),
    "from": (("iterable", 7),),
    "isArray": (("maybeArray", 8),),
    "alloc": (("byteSize", 8),),
    "createHash": (("hashAlgo", 8),),
    "createHmac": (("hashAlgo", 8),),
    "floor": (("number", 7),),
    "ceil": (("number", 7),),
    "round": (("number", 7),),
    "abs": (("number", 7),),
    "pow": (("number", 7), ("number", 7)),
    "sqrt": (("number", 7),),
    "call": (("thisContext", 7),),
    "apply": (("thisContext", 7), ("argsArr", 7)),
    "bind": (("thisContext", 7),),
    "emit": (None, ("eventData", 7)),
}

# Methods all of whose arguments have one type.
ALL_ARGUMENTS = {
    "join": ("pathSegment", 9),
    "resolve": ("pathSegment", 9),
    "log": ("displayable", 5),
    "warn": ("displayable", 5),
    "error": ("displayable", 5),
    "info": ("displayable", 5),
    "debug": ("displayable", 5),
    "max": ("number", 7),
    "min": ("number", 7),
}

# Methods of an object whose arguments differ from those of the method alone.
OBJECT_ARGUMENTS = {
    "Promise.resolve": (("resolvedValue", 7),),
    "Promise.reject": (("rejectionError", 9),),
    "Buffer.from": (("rawData", 8), ("encoding", 7)),
}

# Global functions and the types of their arguments.
FUNCTION_ARGUMENTS = {
    "isNaN": (("number", 7),),
    "isFinite": (("number", 7),),
    "parseInt": (("parseStr", 7), ("radix", 7)),
    "parseFloat": (("parseStr", 7),),
    "String": (("stringifiable", 6),),
    "Number": (("numericStr", 6),),
    "Boolean": (("truthyVal", 6),),
    "Error": (("errorMessage", 8),),
    "TypeError": (("errorMessage", 8),),
    "RangeError": (("errorMessage", 8),),
    "SyntaxError": (("errorMessage", 8),),
    "setTimeout": (("timerFn", 8), ("milliseconds", 8)),
    "setInterval": (("intervalFn", 8), ("milliseconds", 8)),
    "clearTimeout": (("timerId", 8),),
    "clearInterval": (("intervalId", 8),),
    "require": (("modulePath", 9),),
    "fetch": (("url", 8),),
    "structuredClone": (("cloneable", 7),),
}

# Type of a name that is set to such a property, and its score.
ALIAS_PROPERTIES = {
    "message": ("string", 6), "stack": ("string", 7), "code": ("string", 5), "name": ("string", 4), "length": ("number", 6),
    "size": ("number", 5), "status": ("number", 5), "statusCode": ("number", 6), "byteLength": ("number", 6), "body": ("string", 5),
    "data": ("object", 4), "headers": ("object", 6), "error": ("error", 7), "cause": ("error", 6), "signal": ("abortCtrl", 6),
    "url": ("url", 6), "pathname": ("string", 6), "hostname": ("string", 6), "protocol": ("string", 6), "href": ("string", 6),
    "origin": ("string", 6), "host": ("string", 5), "port": ("number", 5), "hash": ("string", 5), "username": ("string", 6),
    "password": ("string", 6), "searchParams": ("urlParams", 7), "env": ("object", 5), "argv": ("array", 7), "pid": ("number", 7),
    "stdout": ("stream", 7), "stderr": ("stream", 7), "stdin": ("stream", 7), "socket": ("stream", 6), "readable": ("boolean", 5),
    "writable": ("boolean", 5), "destroyed": ("boolean", 5), "closed": ("boolean", 5), "pending": ("boolean", 5),
    "prototype": ("object", 6), "constructor": ("function", 6), "then": ("promise", 8), "catch": ("promise", 8),
    "type": ("string", 4), "kind": ("string", 4), "value": ("string", 3), "result": ("object", 4), "output": ("string", 4),
    "input": ("string", 4), "path": ("string", 5), "dir": ("string", 4), "ext": ("string", 4), "base": ("string", 4),
    "prefix": ("string", 4), "suffix": ("string", 4), "encoding": ("string", 5), "format": ("string", 4), "method": ("string", 5),
    "version": ("string", 5), "description": ("string", 4), "title": ("string", 4), "label": ("string", 4), "text": ("string", 4),
    "content": ("string", 4), "source": ("string", 4), "target": ("string", 4), "args": ("array", 6), "params": ("array", 5),
    "items": ("array", 5), "list": ("array", 5), "entries": ("array", 5), "keys": ("array", 5), "values": ("array", 5),
    "children": ("array", 5), "results": ("array", 5), "errors": ("array", 6), "options": ("object", 5), "config": ("object", 5),
    "settings": ("object", 5), "meta": ("object", 4), "context": ("object", 4), "state": ("object", 4), "props": ("object", 4),
    "attributes": ("object", 5), "scope": ("object", 4), "schema": ("object", 5), "model": ("object", 4),
}

# Types of names by their initializer's name, for propagation.
NAME_TYPES = {
    "map": "map", "set": "set", "promise": "promise", "fn": "function", "emitter": "emitter", "timer": "timeout", "buffer": "buffer",
    "arr": "array", "items": "array", "config": "object", "parsed": "object", "merged": "object", "proto": "object",
    "frozen": "object", "keys": "array", "values": "array", "entries": "array", "str": "string", "num": "number", "uuid": "string",
    "timestamp": "number", "url": "url", "buf": "buffer", "regex": "regex", "err": "error", "ws": "websocket", "stream": "stream",
    "hasher": "hasher", "crypto": "crypto", "symbolKey": "symbol", "tpl": "string", "mapped": "array", "filtered": "array",
    "sorted": "array", "parts": "array", "joined": "string", "replaced": "string", "trimmed": "string", "sliced": "array",
    "matched": "array", "reduced": "object", "found": "object", "boundFn": "function", "allPromise": "promise",
    "racePromise": "promise", "resolved": "promise", "rejected": "promise", "serialized": "string", "immediateHandle": "function",
    "microtask": "function", "fromEntries": "object", "maxVal": "number", "minVal": "number", "absVal": "number", "floored": "number",
    "ceiled": "number", "randomVal": "number", "parsedDate": "date", "readStream": "stream", "writeStream": "stream",
    "classDef": "object", "enabled": "boolean", "disabled": "boolean", "errClass": "error", "subClass": "ctor", "rePattern": "regex",
    "namedSym": "symbol",
}

# Properties that come together, the name that they speak for, and its score if all are there.
SHAPES = (
    (("method", "path", "headers", "body"), "httpRequest", 9),
    (("method", "url", "headers", "body"), "httpRequest", 9),
    (("statusCode", "headers", "body"), "httpResponse", 9),
    (("method", "path", "host", "upgrade"), "httpRequest", 9),
    (("body", "headers", "contentLength"), "httpMessage", 8),
    (("host", "port", "pathname"), "urlInfo", 8),
    (("hostname", "port", "protocol"), "addressInfo", 8),
    (("request", "response"), "httpContext", 7),
    (("request", "error"), "requestContext", 7),
    (("websocket", "code", "reason"), "wsEvent", 9),
    (("websocket", "request"), "wsContext", 8),
    (("socket", "server"), "networkContext", 7),
    (("address", "family", "port"), "addressInfo", 8),
    (("connectParams",), "connectOptions", 8),
    (("token", "refreshToken", "expiresAt"), "authTokens", 9),
    (("token", "expiresAt"), "authToken", 8),
    (("userId", "email", "password"), "userCredentials", 9),
    (("userId", "sessionId"), "sessionInfo", 9),
    (("userId", "email"), "userInfo", 8),
    (("accessToken", "scope"), "oauthToken", 9),
    (("username", "password"), "credentials", 9),
    (("sessionId", "token"), "sessionData", 8),
    (("command", "args", "flags"), "cliOptions", 9),
    (("command", "description"), "commandInfo", 8),
    (("name", "description", "flags"), "commandDef", 9),
    (("name", "version", "description"), "packageInfo", 8),
    (("command", "output"), "commandResult", 8),
    (("type", "payload"), "eventData", 8),
    (("type", "data"), "eventData", 7),
    (("event", "handler"), "eventBinding", 8),
    (("once", "on", "emit"), "emitter", 8),
    (("on", "off", "emit"), "emitter", 8),
    (("name", "filename", "contentType", "encoding"), "fileInfo", 9),
    (("name", "filename", "contentType"), "fileInfo", 9),
    (("filename", "size", "type"), "fileInfo", 9),
    (("path", "mode", "flags"), "fileOptions", 8),
    (("read", "write", "close"), "fileHandle", 8),
    (("readFile", "writeFile"), "fs", 8),
    (("message", "stack", "code"), "errorInfo", 9),
    (("error", "message"), "errorContext", 8),
    (("error", "cause"), "errorInfo", 8),
    (("key", "defaultValue", "required", "converter"), "schemaField", 9),
    (("key", "value", "ttl"), "cacheEntry", 9),
    (("key", "defaultValue"), "configEntry", 8),
    (("enabled", "timeout"), "options", 7),
    (("debug", "verbose", "silent"), "logOptions", 8),
    (("level", "message", "timestamp"), "logEntry", 9),
    (("getFormDataState", "setFormDataState"), "formDataCtx", 9),
    (("value", "onChange"), "fieldState", 8),
    (("state", "setState"), "stateCtx", 8),
    (("getState", "dispatch"), "store", 9),
    (("start", "end"), "range", 7),
    (("start", "end", "step"), "range", 8),
    (("x", "y", "width", "height"), "rect", 9),
    (("width", "height"), "size", 7),
    (("resolve", "reject"), "deferred", 9),
    (("subscribe", "unsubscribe"), "subscription", 9),
    (("next", "done", "value"), "iterResult", 8),
    (("push", "pop", "shift", "unshift"), "stack", 8),
)

# Tables of constants: name, score, how many of the properties must be there, and the properties.
NAMESPACES = (
    ("httpMethods", 9, 2, ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE", "CONNECT")),
    ("htmlTags", 9, 3, ("TBODY", "THEAD", "TFOOT", "CAPTION", "COLGROUP", "TABLE", "TR", "TD", "TH", "BODY", "HEAD", "HTML", "DIV", "SPAN", "FORM")),
    ("htmlElems", 8, 3, ("ADDRESS", "APPLET", "AREA", "ARTICLE", "ASIDE", "BASE", "BASEFONT", "BGSOUND", "BLOCKQUOTE", "CENTER", "FRAME")),
    ("lspRequests", 9, 2, ("WorkspaceSymbolRequest", "CodeActionRequest", "DocumentSymbolRequest", "ReferencesRequest", "DefinitionRequest", "SignatureHelpRequest", "DocumentHighlightRequest")),
    ("lspProto", 9, 2, ("ProgressType", "createMessageConnection", "NullLogger", "ConnectionOptions", "ConnectionStrategy", "AbstractMessageBuffer", "WriteableStreamMessageWriter")),
    ("lspNotifs", 8, 2, ("NotificationType9", "NotificationType8", "NotificationType7", "NotificationType6", "NotificationType5")),
    ("domErrors", 9, 2, ("IndexSizeError", "HierarchyRequestError", "WrongDocumentError", "InvalidCharacterError", "NotFoundError", "NotSupportedError", "NamespaceError")),
    ("yogaConsts", 9, 2, ("POSITION_TYPE_ABSOLUTE", "POSITION_TYPE_RELATIVE", "EDGE_ALL", "EDGE_HORIZONTAL", "EDGE_VERTICAL", "EDGE_START", "EDGE_END")),
    ("httpParserConsts", 8, 3, ("SPECIAL_HEADERS", "HTAB_SP_VCHAR_OBS_TEXT", "QUOTED_STRING", "CONNECTION_TOKEN_CHARS", "HEADER_CHARS", "TOKEN", "MINOR", "MAJOR")),
    ("charCodes", 8, 3, ("SPACE", "LINE_FEED", "TABULATION", "FORM_FEED", "DIGIT_0", "DIGIT_9", "LATIN_CAPITAL_A", "LATIN_CAPITAL_Z", "LATIN_SMALL_A")),
    ("semverParts", 9, 2, ("NUMERICIDENTIFIER", "NONNUMERICIDENTIFIER", "MAINVERSION", "MAINVERSIONLOOSE", "PRERELEASEIDENTIFIER", "PRERELEASEIDENTIFIERLOOSE")),
    ("typeEnum", 8, 3, ("domElement", "observable", "array", "buffer", "undefined", "string", "number", "nan", "boolean", "object", "function")),
    ("htmlParseErrors", 9, 3, ("duplicateAttribute", "unexpectedNullCharacter", "unexpectedQuestionMarkInsteadOfTagName", "eofBeforeTagName", "invalidFirstCharacterOfTagName", "missingEndTagName")),
    ("domNodeTypes", 9, 3, ("ELEMENT_NODE", "ATTRIBUTE_NODE", "TEXT_NODE", "CDATA_SECTION_NODE", "ENTITY_REFERENCE_NODE", "ENTITY_NODE", "PROCESSING_INSTRUCTION_NODE", "COMMENT_NODE", "DOCUMENT_NODE", "DOCUMENT_FRAGMENT_NODE")),
    ("semverRegexKeys", 9, 4, ("HYPHENRANGELOOSE", "HYPHENRANGE", "COMPARATORTRIM", "TILDETRIM", "CARETTRIM", "COMPARATORLOOSE", "BUILD", "TILDELOOSE", "TILDE", "CARET")),
    ("yamlNodeTypes", 9, 4, ("ALIAS", "DOC", "MAP", "NODE_TYPE", "PAIR", "SCALAR", "SEQ")),
    ("sqliteConsts", 9, 3, ("SQLITE_READ", "SQLITE_SELECT", "SQLITE_FUNCTION", "SQLITE_RECURSIVE", "SQLITE_OK", "SQLITE_PRAGMA", "SQLITE_DENY", "SQLITE_CREATE_TABLE", "SQLITE_DROP_TABLE")),
    ("termEnvVars", 9, 4, ("FORCE_COLOR", "TERM", "CI_NAME", "TEAMCITY_VERSION", "COLORTERM", "TERM_PROGRAM_VERSION", "TERM_PROGRAM", "NO_COLOR", "FORCE_LEVEL")),
    ("wsOpcodes", 9, 4, ("CLOSE", "PING", "PONG", "CONTINUATION", "TEXT", "BINARY")),
    ("xmlNamespaces", 9, 4, ("XML", "XLINK", "XMLNS", "HTML", "SVG", "MATHML")),
    ("vdomOps", 8, 4, ("VALUE", "ATTR", "REMOVE_ATTR", "REMOVE", "INSERT", "MOVE", "REPLACE")),
    ("parse5Consts", 9, 4, ("NAMESPACES", "ATTRS", "DOCUMENT_MODE", "TAG_NAMES", "SPECIAL_ELEMENTS")),
    ("htmlSpecialStr", 9, 3, ("SCRIPT_STRING", "DASH_DASH_STRING", "DOCTYPE_STRING", "CDATA_START_STRING", "PUBLIC_STRING", "SYSTEM_STRING")),
    ("lspFileEvents", 9, 3, ("DidCreateFilesNotification", "WillCreateFilesRequest", "DidRenameFilesNotification", "WillRenameFilesRequest", "DidDeleteFilesNotification", "WillDeleteFilesRequest")),
    ("lspProtoTypes", 9, 3, ("ProtocolNotificationType", "ProtocolNotificationType0", "ProtocolRequestType", "ProtocolRequestType0", "RegistrationType")),
    ("lspSemTokens", 9, 3, ("SemanticTokensRefreshRequest", "SemanticTokensRangeRequest", "SemanticTokensDeltaRequest", "SemanticTokensRequest", "SemanticTokensRegistrationType")),
    ("lspNotebookDocs", 9, 3, ("DidOpenNotebookDocumentNotification", "DidChangeNotebookDocumentNotification", "DidSaveNotebookDocumentNotification", "DidCloseNotebookDocumentNotification", "NotebookDocumentSyncRegistrationType")),
    ("lspCallHierarchy", 9, 2, ("CallHierarchyOutgoingCallsRequest", "CallHierarchyIncomingCallsRequest", "CallHierarchyPrepareRequest")),
    ("lspRpcTypes", 8, 3, ("RequestType0", "RequestType", "NotificationType0", "NotificationType", "ProgressType")),
)

# Words of the cases of a switch; the first vocabulary that fits names the type of what is switched on.
# Vocabulary, type, score, whether all cases must be words of it (two cases at least) or any; events are the words of EVENTS and EVENT_HANDLERS.
SWITCH_WORDS = (
    (("invalid_type", "invalid_value", "too_big", "too_small", "invalid_format", "not_multiple_of", "unrecognized_keys", "invalid_key", "invalid_union", "invalid_element"), "zodError", 8, "any"),
    (("string", "number", "boolean", "object", "function", "symbol", "undefined", "bigint", "null"), "string", 6, "all"),
    ((*EVENTS, *EVENT_HANDLERS), "eventType", 7, "all"),
    (("html", "body", "head", "comment", "text", "space", "newline", "tag", "attribute", "doctype"), "parserToken", 7, "any"),
    (("error", "success", "pending", "rejected", "resolved", "cancelled", "running", "idle", "done"), "statusStr", 7, "any"),
    (("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"), "httpMethod", 8, "any"),
)

# Objects whose methods, handed to a factory, name what it makes.
FACTORY_OBJECTS = ("Object", "Array", "Function", "Math", "String", "Number", "Date", "RegExp", "Promise", "Reflect", "Proxy")
