"""Structured Streaming forms of the online path.

* ``stage_request_files``  write the request log as a file stream source
* ``admission_stream``     micro-batch admission against a snapshot cache (T3, S7)
* ``audit_rate_stream``    watermarked windowed audit-failure rates (T4)
* ``dedupe_requests``      exactly one decision per request id (T6)
* ``ledger_stream``        per-tenant budget state across micro-batches (T5)
"""
