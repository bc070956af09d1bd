import sys

from scorelake.cli import main

sys.exit(main())
