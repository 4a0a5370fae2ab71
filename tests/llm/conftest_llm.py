"""Helpers of these tests."""


def rows_of(docs) -> list[tuple]:
    return [(r.doc_id, r.text) for r in docs.collect()]
