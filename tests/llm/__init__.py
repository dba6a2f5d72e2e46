"""A package, so that a module here can have the name of one in the folder above."""

import sys
from pathlib import Path

sys.path.append(str(Path(__file__).resolve().parent))  # the modules here import each other by their plain names
