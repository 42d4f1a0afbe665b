"""Row-by-row model of the ingest rules, for comparison only."""

from stellwerk.functions.similarity import ratio


def run(batch, state, ts):
    """``batch``: dicts in arrival order with normalised keys. Returns outcome rows."""
    result = []
    for p in batch:
        if p["company_key"] not in state["companies"]:
            state["companies"][p["company_key"]] = p["company_name"]
        job, stage = None, None
        if p["source_job_id"]:
            for s in state["sources"].values():
                if (s["source_name"], s["source_job_id"]) == (p["source_name"], p["source_job_id"]):
                    job, stage = s["job"], "source_id"
                    break
        if job is None and p["canonical_id"] in state["jobs"]:
            job, stage = p["canonical_id"], "canonical_id"
        if job is not None:
            known = state["jobs"][job]
            known["last_seen_at"] = ts
            if p["raw_text"] and not known["raw_text"]:
                known["raw_text"] = p["raw_text"]
            _link(state, p, job, ts)
            result.append((p["seq"], "duplicate", stage, job))
            continue
        similar = any(
            j["company_key"] == p["company_key"] and j["is_active"]
            and ratio(p["title_norm"], j["title_norm"]) >= 0.85
            for j in state["jobs"].values()
        )
        if similar:
            result.append((p["seq"], "duplicate", "similar_title", None))
            continue
        state["jobs"][p["canonical_id"]] = {
            "company_key": p["company_key"], "title_norm": p["title_norm"], "is_active": True,
            "last_seen_at": ts, "first_seen_at": ts, "raw_text": p["raw_text"],
        }
        _link(state, p, p["canonical_id"], ts)
        result.append((p["seq"], "new", None, p["canonical_id"]))
    return result


def _link(state, p, job, ts):
    if p["url"] in state["sources"]:
        state["sources"][p["url"]]["last_seen_at"] = ts
    else:
        state["sources"][p["url"]] = {
            "job": job, "source_name": p["source_name"], "source_job_id": p["source_job_id"],
            "first_seen_at": ts, "last_seen_at": ts,
        }
