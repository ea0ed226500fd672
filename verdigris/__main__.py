import sys

from verdigris.cli import main

sys.exit(main())
