"""A service of pages, nested blocks and events in one JSON file, whose path stands in the address; answers hold two items."""

import json
import os
import urllib.parse

SIZE = 2


def serve(method, url, body, headers=None):
    split = urllib.parse.urlsplit(url)
    asked = dict(urllib.parse.parse_qsl(split.query)) if method == "GET" else body
    path, _, what = split.path.partition(".json/")
    with open(f"{path}.json") as file:
        data = json.load(file)
    with open(f"{path}.calls", "a") as file:
        file.write(f"{what} {asked.get('start_cursor', asked.get('pageToken', '0'))} {os.getpid()}\n")
    if what == "events":
        return answer([e for e in sorted(data["events"], key=lambda e: e["updated"]) if e["updated"] >= asked.get("updatedMin", "")], int(asked.get("pageToken", 0)), "items", "nextPageToken")
    if what == "search":
        assert method == "POST" and headers["Notion-Version"] and asked["sort"]["direction"] == "descending"
        return answer(sorted(data["pages"], key=lambda p: p["last_edited_time"], reverse=True), int(asked.get("start_cursor", 0)), "results", "next_cursor")
    return answer(data["children"].get(what.split("/")[1], []), int(asked.get("start_cursor", 0)), "results", "next_cursor")


def answer(items, at, name, more):
    return 200, {}, {name: items[at : at + SIZE], more: str(at + SIZE) if at + SIZE < len(items) else None}
