import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import docs, no_docs  # noqa: E402, F401
