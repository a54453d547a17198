"""Pipeline operators: discovery, link graph, extraction, canonical pages,
documents, audit metrics and read views."""
