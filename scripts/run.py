"""What scripts/submit.sh hands to spark-submit."""

import sys

from tidewatch.__main__ import main

if __name__ == "__main__":
    sys.exit(main())
