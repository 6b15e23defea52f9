"""A small seeded emitter of telemetry for tests: batch files as they arrive, and what is true of them."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

START = datetime(2026, 8, 9, 10, 0)


def emit(folder: str, robots: int = 6, minutes: int = 20, seed: int = 42, late: float = 0.1, again: float = 0.05) -> dict:
    """Write lote-NNNN.json files, one a minute; some readings come up to four minutes late, some twice."""
    r = random.Random(seed)
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    boxes: dict[int, list] = {m: [] for m in range(minutes)}
    truth = {"lecturas": 0, "tarde": 0, "copias": 0}
    for m in range(minutes):
        for k in range(robots):
            row = {"robot_id": f"RBT-{k:04d}", "almacen": "Malmo", "sensor": "temperatura", "valor": round(55 + r.gauss(0, 2) + (25 if k == 0 and m > minutes // 2 else 0), 2), "ts_evento": (START + timedelta(minutes=m, seconds=r.randrange(60))).isoformat() + "Z", "intento": 1}
            at = m + (r.randrange(1, 5) if r.random() < late else 0)
            if at >= minutes:
                continue
            truth["lecturas"] += 1
            truth["tarde"] += at > m
            boxes[at].append(row)
            if r.random() < again and at + 1 < minutes:
                boxes[at + 1].append(row | {"intento": 2})
                truth["copias"] += 1
    for m, rows in boxes.items():
        (path / f"lote-{m:04d}.json").write_text("".join(json.dumps(x) + "\n" for x in rows))
    (path / "_emision.json").write_text(json.dumps(truth))
    return truth
