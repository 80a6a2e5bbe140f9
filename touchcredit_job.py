"""Runs a report: ``spark-submit --py-files <the package> touchcredit_job.py <report> <settings.json>``."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from touchcredit.jobs import main  # noqa: E402

main()
