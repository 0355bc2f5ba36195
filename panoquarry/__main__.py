"""Runs from the command line: python -m panoquarry scan|label|score|submit|gallery|overlay.

Services and pictures are those of sources.street_view, with a model of the hub; or functions of a
module of the user's, named by --services: ``services`` (a plans.runs.Services) and ``model`` for scan and
label, ``fetch`` and ``save`` for gallery, ``fetch`` for overlay.
"""

from __future__ import annotations

import argparse
import importlib
import os
import urllib.error
import urllib.request

from pyspark.sql import SparkSession

from panoquarry.functions.pictures import Jpeg
from panoquarry.plans import runs
from panoquarry.sources import files, street_view


class Post:
    """Sends a payload as JSON and gives the HTTP status; errors of the connection raise."""

    def __init__(self, endpoint: str, api_key: str | None, timeout: float = 30.0):
        self.endpoint, self.timeout = endpoint, timeout
        self.headers = {"Content-Type": "application/json", "Accept": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})

    def __call__(self, body: str) -> int:
        request = urllib.request.Request(self.endpoint, body.encode(), self.headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.status
        except urllib.error.HTTPError as e:
            return e.code


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="panoquarry")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "label"):
        c = commands.add_parser(name)
        c.add_argument("area", help="GeoJSON file of a bare Polygon or MultiPolygon")
        c.add_argument("run", help="folder of the run")
        c.add_argument("--services")
        c.add_argument("--hub-model", help="the model's name on the hub; label needs it or --services")
        c.add_argument("--trust-remote-code", action="store_true", help="run code that the model brings")
        for flag in ("--model-id", "--model-training-date", "--api-version"):
            c.add_argument(flag, default="", help="what records say of the model")
        c.add_argument("--coverage-tasks", type=int, default=100)
        c.add_argument("--tasks", type=int, default=50)
        c.add_argument("--threads", type=int, default=1)
    c = commands.add_parser("score")
    c.add_argument("run")
    c.add_argument("verdicts", nargs="?")
    c.add_argument("--assume-scanned", action="store_true")
    c = commands.add_parser("submit")
    c.add_argument("file")
    c.add_argument("--endpoint", help="address that takes payloads; needed unless it is a dry run")
    c.add_argument("--api-key-env", help="name of the environment variable that holds the key")
    c.add_argument("--dry-run", action="store_true")
    c = commands.add_parser("gallery")
    c.add_argument("run")
    c.add_argument("--services")
    for flag, least in (("--sample", 100), ("--empty-sample", 10), ("--seed", 0)):
        c.add_argument(flag, type=int, default=least)
    c.add_argument("--out")
    c = commands.add_parser("overlay")
    c.add_argument("run")
    c.add_argument("out", help="picture that is written")
    c.add_argument("--services")
    a = parser.parse_args(argv)
    if a.command == "label" and not (a.services or a.hub_model):
        parser.error("label needs --hub-model or --services")
    if a.command == "submit" and not (a.endpoint or a.dry_run):
        parser.error("submit needs --endpoint")
    return a


def main(argv: list[str] | None = None) -> runs.Report:
    a = arguments(argv)
    spark = SparkSession.builder.appName("panoquarry").getOrCreate()
    given = importlib.import_module(a.services) if getattr(a, "services", None) else None
    fetch = given.fetch if hasattr(given, "fetch") else street_view.fetch
    if a.command in ("scan", "label"):
        services = given.services if given else street_view.services(a.hub_model, a.trust_remote_code)
        model = given.model if given else {"model_id": a.model_id or a.hub_model or "", "model_training_date": a.model_training_date, "api_version": a.api_version}
        report = runs.label(spark, a.run, a.area, services, model, a.command == "scan", a.coverage_tasks, a.tasks, a.threads)
    elif a.command == "score":
        report = runs.score(spark, a.run, a.verdicts, a.assume_scanned)
    elif a.command == "submit":
        report = runs.submit(spark, a.file, Post(a.endpoint, os.environ.get(a.api_key_env) if a.api_key_env else None), a.dry_run)
    elif a.command == "overlay":
        report = runs.overlay(spark, a.run, fetch, a.out)
    else:
        out = a.out or f"{files.results_path(a.run).rsplit('/', 1)[0]}/spot_check"
        report = runs.build_gallery(spark, a.run, fetch, given.save if given else Jpeg(f"{out.removeprefix('file://')}/images"), a.sample, a.empty_sample, a.seed, out)
    for warning in report.warnings:
        print("warning:", warning)
    for name, value in report.counts.items():
        print(f"{name}: {value}")
    for name, frame in report.frames.items():
        if name.endswith("sweep") or name == "payloads":
            print(name)
            frame.show(truncate=False)
    return report


if __name__ == "__main__":
    main()
