"""A bundle on disk, whole and tampered with in each way that the replay must find."""

import hashlib
import json

import pytest

from lodestrata.sources import evidence


def url(n):
    return f"https://forge.test/commits?page={n}"


def made(folder, tamper=None):
    """Three pages, the second one asked for twice as the first answer was an error; `tamper` changes records and claims."""
    bodies = [[{"sha": f"{n}{i}", "author": None if i == 2 else {"login": f"u{i}"}} for i in range(3)] for n in (1, 3, 4)]
    answers = [(1, 200, bodies[0], 2), (2, 503, None, 2), (2, 200, bodies[1], 3), (3, 200, bodies[2], None)]
    pages, blobs = [], {}
    for number, (page, status, items, follows) in enumerate(answers, 1):
        body = json.dumps(items).encode() if items else b"busy"
        digest = hashlib.sha256(body).hexdigest()
        blobs[digest] = body
        pages.append({"source": "a", "number": number, "request": url(page), "next_request": follows and url(follows), "http_status": status, "link": f'<{url(follows)}>; rel="next"' if status == 200 and follows else None, "body_sha256": digest, "body_bytes": len(body), "item_count": len(items or [])})
    sources = [{"source": "a", "first_request": url(1), "pages": 4, "item_count": 9, "unlinked": 3, "coverage": "complete"}]
    if tamper:
        tamper(pages, sources, blobs)
    (folder / "blobs" / "sha256").mkdir(parents=True)
    for name, body in blobs.items():
        (folder / "blobs" / "sha256" / name).write_bytes(body)
    for name, rows in (("pages", pages), ("sources", sources)):
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(folder)


def replayed(spark, folder):
    faults, verdicts = evidence.replay(*evidence.read_bundle(spark, folder))
    return {r.source: r for r in verdicts.collect()}, {(r.number, r.reason) for r in faults.collect()}


def test_a_whole_bundle(spark, tmp_path):
    verdicts, faults = replayed(spark, made(tmp_path / "b"))
    r = verdicts["a"]
    assert (r.status, r.reason, r.coverage, r.pages, r["items"], r.oids) == ("VERIFIED", None, "complete", 4, 9, 9) and not faults


def set_page(n, **values):
    return lambda pages, sources, blobs: pages[n - 1].update(values)


def set_source(**values):
    return lambda pages, sources, blobs: sources[0].update(values)


def change_body(pages, sources, blobs):
    blobs[pages[0]["body_sha256"]] = blobs[pages[0]["body_sha256"]].replace(b"u1", b"u7")


def repeat_items(pages, sources, blobs):
    pages[3].update({k: pages[2][k] for k in ("body_sha256", "body_bytes")})


def change_account(pages, sources, blobs):
    body = blobs[pages[2]["body_sha256"]].replace(b'"30"', b'"10"').replace(b"u0", b"other")
    digest = hashlib.sha256(body).hexdigest()
    blobs[digest] = body
    pages[2].update(body_sha256=digest, body_bytes=len(body))


TAMPERED = {
    "page_number_mismatch": set_page(4, number=5),
    "request_chain_mismatch": set_page(3, request=url(9)),
    "body_missing": lambda pages, sources, blobs: blobs.pop(pages[0]["body_sha256"]),
    "body_digest_mismatch": change_body,
    "body_bytes_mismatch": set_page(1, body_bytes=1),
    "http_status_invalid": set_page(2, http_status=None),
    "http_retry_semantics_mismatch": set_page(2, item_count=1),
    "item_count_mismatch": set_page(3, item_count=2),
    "page_next_request_mismatch": set_page(1, link=None),
    "request_chain_terminated_early": set_page(3, next_request=None),
    "source_undeclared": set_source(source="b"),
    "unlinked_mismatch": set_source(unlinked=2),
    "duplicate_oids": repeat_items,
    "account_conflicts": change_account,
    "pagination_mismatch": set_source(coverage="partial"),
}


def test_every_reason_has_a_case():
    assert set(TAMPERED) == set(evidence.REASONS)


@pytest.mark.parametrize("reason", TAMPERED)
def test_tampering_is_found(spark, tmp_path, reason):
    verdicts, faults = replayed(spark, made(tmp_path / "b", TAMPERED[reason]))
    assert reason in {r for _, r in faults}
    if "a" in verdicts:
        assert verdicts["a"].status == ("CANNOT_VERIFY" if reason == "body_missing" else "MISMATCH")


def test_a_cut_history_is_partial(spark, tmp_path):
    def cut(pages, sources, blobs):
        pages.pop()
        sources[0].update(pages=3, item_count=6, unlinked=2, coverage="partial")

    verdicts, faults = replayed(spark, made(tmp_path / "b", cut))
    assert verdicts["a"].status == "VERIFIED" and verdicts["a"].coverage == "partial" and not faults
