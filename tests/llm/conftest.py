import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))  # tests compare with each other's brute forces
