import sys

from prosegauge.cli import main

sys.exit(main())
