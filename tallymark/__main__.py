import sys

from tallymark.cli import main

sys.exit(main())
