import sys

from logweave.cli import main

sys.exit(main())
