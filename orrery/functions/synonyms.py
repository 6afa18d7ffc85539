"""Synonyms of words that code is searched by."""

from __future__ import annotations

# Synonyms of a word, in the order in which they are tried.
SYNONYMS = {
    "db": "database datastore storage",
    "database": "db datastore storage sql postgres mysql sqlite",
    "auth": "authentication authorization login signin",
    "authentication": "auth login signin session token jwt",
    "login": "signin auth authenticate session",
    "api": "endpoint route handler rest http",
    "endpoint": "api route handler url path",
    "err": "error exception failure fault",
    "error": "err exception failure fault panic crash",
    "config": "configuration settings preferences options",
    "configuration": "config settings preferences env",
    "msg": "message notification alert",
    "message": "msg notification alert event",
    "req": "request http input",
    "request": "req http input payload",
    "resp": "response reply output",
    "response": "resp reply output result",
    "repo": "repository git codebase",
    "repository": "repo git codebase project",
    "fn": "function func method handler",
    "function": "fn func method handler def",
    "pkg": "package module library",
    "package": "pkg module library import",
    "ctx": "context state",
    "context": "ctx state scope",
    "middleware": "interceptor handler filter hook",
    "cache": "redis memcache store memo",
    "queue": "kafka rabbitmq nats pubsub event",
    "test": "testing spec unittest pytest mock",
    "deploy": "deployment release ci cd pipeline",
    "log": "logging logger trace debug print",
    "user": "account profile member client",
    "payment": "billing invoice charge stripe transaction",
    "search": "find query lookup filter retrieve",
    "send": "emit dispatch publish push notify",
    "worker": "job task background async goroutine",
    "validate": "validation check verify sanitize",
    "connect": "connection dial open establish",
    "parse": "parsing decode unmarshal deserialize",
    "serialize": "marshal encode json format",
}

ROWS = [(word, place, synonym) for word, found in SYNONYMS.items() for place, synonym in enumerate(found.split())]
