"""Function API with the service's rules: `predict` for one pair, `predict_batch` for many; `register` puts the kernels into SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .operators.sentiment import predict as _predict

REQUEST = "sentence string, target_text string, target_from int, target_to int"


def predict_batch(spark: SparkSession, requests: list[dict], fail_on_error: bool = True) -> list[dict]:
    """requests: sentence, target[, target_from, target_to]. By default the first bad item fails the whole batch with ValueError."""
    if not requests:
        raise ValueError("at least one request is needed")
    rows = [(r.get("sentence"), r.get("target"), r.get("target_from"), r.get("target_to")) for r in requests]
    out = [r.asDict(recursive=True) for r in _predict(spark.createDataFrame(rows, REQUEST)).collect()]  # as many rows as the caller sent
    bad = next((r["error"] for r in out if r["error"]), None)
    if bad and fail_on_error:
        raise ValueError(bad)
    return out


def predict(spark: SparkSession, sentence: str, target: str, target_from: int | None = None, target_to: int | None = None) -> dict:
    return predict_batch(spark, [{"sentence": sentence, "target": target, "target_from": target_from, "target_to": target_to}])[0]


def health() -> dict:
    return {"status": "ok"}


def root() -> dict:
    return {"service": "tonefield", "paths": ["/health", "/predict", "/predict/batch"]}


def invalid(request: dict) -> list[str]:
    """What a request's own shape breaks, before any text is looked at: an empty sentence or target, a negative offset."""
    out = [f"{k} is empty" for k in ("sentence", "target") if not request.get(k)]
    return out + [f"{k} is negative" for k in ("target_from", "target_to") if (request.get(k) or 0) < 0]


def respond(spark: SparkSession, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
    """(status, document) as the service answers: 422 for a request of the wrong shape, 400 for values that do not fit the sentence, 404 else."""
    if method == "GET" and path in ("/", "/health"):
        return 200, root() if path == "/" else health()
    if method != "POST" or path not in ("/predict", "/predict/batch"):
        return 404, {"detail": "not found"}
    requests = [body or {}] if path == "/predict" else (body or {}).get("requests", [])
    wrong = [x for r in requests for x in invalid(r)] or ["at least one request is needed"] * (not requests)
    if wrong:
        return 422, {"detail": wrong}
    try:
        out = predict_batch(spark, requests)
    except ValueError as e:
        return 400, {"detail": str(e)}
    return 200, out[0] if path == "/predict" else {"results": out}


def register(spark: SparkSession) -> None:
    """SQL functions: table function extract_targets(sentence), scalar clean_edges(text)."""
    from pyspark.sql import functions as F

    from .functions.text import cleaned
    from .operators.extract import build
    from .operators.parse import rules
    from .operators.targets import select_all

    class Targets:
        def eval(self, sentence: str):
            for k, t in enumerate(select_all(build(rules([sentence or ""])[0]))):
                yield k, t.target, t.role, t.confidence

    spark.udtf.register("extract_targets", F.udtf(Targets, returnType="target_pos int, target string, role string, confidence string"))

    import pandas as pd

    def clean(text):
        return text.map(cleaned, na_action="ignore")

    clean.__annotations__ = {"text": pd.Series, "return": pd.Series}
    spark.udf.register("clean_edges", F.pandas_udf(clean, "string"))
