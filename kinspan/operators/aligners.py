"""External alignment tools behind one interface, run per dataset inside Spark tasks.

A tool is a course of steps over files in a folder of its own: commands, and small rewritings between them.  The
tools are optional; a dataset whose tool is missing, fails or takes too long gives a row that says so.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from ..sources.structures import consensus_structure

RESULT = (
    "dataset string, pipeline string, is_successful boolean, message string, seconds double, peak_mb double, header string, sequence string"
)


@dataclass(frozen=True)
class Step:
    """A command in the dataset's folder; what it prints goes to the file ``prints``."""

    command: tuple[str, ...]
    prints: str = "printed"
    timeout: float = 120.0

    def __call__(self, folder: Path) -> float:
        """Run it; the peak memory of the process in MB, as the kernel counts it when it ends."""
        with open(folder / self.prints, "wb") as out, open(folder / "errors", "w+b") as err:
            process = subprocess.Popen(self.command, cwd=folder, stdout=out, stderr=err)
            late = threading.Event()
            clock = threading.Timer(self.timeout, lambda: (late.set(), process.kill()))
            clock.start()
            _, status, usage = os.wait4(process.pid, 0)
            clock.cancel()
            process.returncode = os.waitstatus_to_exitcode(status)
            if late.is_set():
                raise RuntimeError(f"{self.command[0]} was stopped after {self.timeout} seconds")
            if process.returncode:
                err.seek(0)
                raise RuntimeError(f"{self.command[0]}: exit code {process.returncode}: {err.read()[-500:].decode(errors='replace')}")
        return usage.ru_maxrss / 1024


@dataclass(frozen=True)
class Aligner:
    """A tool by its steps, which find the sequences in ``in.fasta`` and leave the alignment in the file ``result``."""

    name: str
    steps: tuple[Step | Callable[[Path], None], ...]
    result: str = "printed"

    def missing(self) -> list[str]:
        """The programs that are not installed."""
        return sorted({s.command[0] for s in self.steps if isinstance(s, Step) and shutil.which(s.command[0]) is None})

    def align(self, fasta: str) -> tuple[list[tuple[str, str]], float]:
        """The aligned sequences by header, and the peak memory of the largest step."""
        with tempfile.TemporaryDirectory() as name:
            folder = Path(name)
            (folder / "in.fasta").write_text(fasta)
            peak = max([step(folder) or 0.0 for step in self.steps])
            text = (folder / self.result).read_text()
        return (parse_stockholm(text) if text.startswith("# STOCKHOLM") else parse_fasta(text)), peak


def parse_fasta(text: str) -> list[tuple[str, str]]:
    parts = [p.split("\n", 1) for p in text.split(">")[1:]]
    return [(p[0].split()[0], "".join(p[1].split()) if len(p) > 1 else "") for p in parts if p[0].split()]


def parse_stockholm(text: str) -> list[tuple[str, str]]:
    """Sequences of a Stockholm file, whose lines may be in several blocks."""
    found: dict[str, list[str]] = {}
    for line in text.splitlines():
        words = line.split()
        if len(words) > 1 and not words[0].startswith("#"):
            found.setdefault(words[0], []).append(words[1])
    return [(header, "".join(pieces)) for header, pieces in found.items()]


def with_structure(folder: Path) -> None:
    """The first alignment as a Stockholm file with the consensus structure that was folded for it."""
    rows = parse_fasta((folder / "first.fasta").read_text())
    structure = consensus_structure((folder / "folded").read_text())
    if structure:
        rows.append(("#=GC SS_cons", structure))
    lines = [f"{header:<30} {sequence}" for header, sequence in rows]
    (folder / "first.sto").write_text("\n".join(["# STOCKHOLM 1.0", "", *lines, "//", ""]))


#: The programs' options.
_MAFFT = ("mafft", "--ep", "0.0", "--adjustdirection", "--maxiterate", "1000")


def _muscle(name: str, *options: str) -> Aligner:
    return Aligner(name, (Step(("muscle", *options, "-output", "out.fasta")),), "out.fasta")


#: The tools by name; of several variants the first whose programs are all installed is taken.
ALIGNERS: dict[str, tuple[Aligner, ...]] = {
    variants[0].name: variants
    for variants in (
        (_muscle("muscle5", "-align", "in.fasta"),),
        (_muscle("muscle5_super5", "-super5", "in.fasta"),),
        (_muscle("muscle5_stratified", "-align", "in.fasta", "-stratified"),),
        (_muscle("muscle5_diversified", "-align", "in.fasta", "-diversified"),),
        (Aligner("mafft_qinsi", (Step((*_MAFFT, "--qinsi", "--op", "2.5", "in.fasta")),)),),
        (Aligner("mafft_linsi", (Step((*_MAFFT, "--localpair", "--op", "3.0", "in.fasta")),)),),
        (Aligner("mafft_xinsi", (Step((*_MAFFT, "--xinsi", "in.fasta")),)),),
        (Aligner("rcoffee", (Step(("t_coffee", "in.fasta", "-mode", "rcoffee", "-output", "fasta_aln", "-outfile", "out.fasta")),), "out.fasta"),),
        (
            Aligner("structural_encoding", (Step(("mafft-qinsi", "--qinsi", "--ep", "0.0", "--maxiterate", "1000", "in.fasta")),)),
            Aligner("structural_encoding", (Step(("mafft", "--globalpair", "--ep", "0.0", "--maxiterate", "1000", "in.fasta")),)),
        ),
        (
            # an alignment, its consensus structure, a covariance model of both, and the sequences aligned to the model
            Aligner(
                "profile_cm_pipeline",
                (
                    Step((*_MAFFT, "--localpair", "--op", "3.0", "in.fasta"), "first.fasta"),
                    Step(("RNAalifold", "--noLP", "--noPS", "first.fasta"), "folded", 60.0),
                    with_structure,
                    Step(("cmbuild", "first.cm", "first.sto")),
                    Step(("cmalign", "--glocal", "-o", "refined.sto", "first.cm", "in.fasta")),
                ),
                "refined.sto",
            ),
        ),
    )
}


def align(datasets: DataFrame, aligner: Aligner | tuple[Aligner, ...]) -> DataFrame:
    """Aligned sequences of each dataset (``dataset, header, sequence``), or one row with the reason why there are none.

    Datasets of fewer than two sequences are not aligned.  ``seconds`` and ``peak_mb`` are of the whole course and
    of its largest step.
    """
    variants = aligner if isinstance(aligner, tuple) else (aligner,)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        begun, peak = time.monotonic(), 0.0
        made: list[tuple[str, str]] = []
        message = None
        chosen = next((a for a in variants if not a.missing()), None)
        if len(rows) < 2:
            message = "fewer than two sequences"
        elif chosen is None:
            message = f"{', '.join(variants[-1].missing())} not installed"
        else:
            fasta = "".join(f">{h}\n{s}\n" for h, s in rows.sort_values("header")[["header", "sequence"]].itertuples(index=False))
            try:
                made, peak = chosen.align(fasta)
                message = None if made else "the tool gave no sequence"
            except (RuntimeError, OSError) as error:
                message = str(error)
        took = time.monotonic() - begun
        out = [(rows["dataset"].iloc[0], variants[0].name, not message, message, took, peak, h, s) for h, s in made or [(None, None)]]
        return pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    return datasets.groupBy("dataset").applyInPandas(run, RESULT)
