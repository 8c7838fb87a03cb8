from chunkweave.cli import main

main()
